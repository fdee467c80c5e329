from __future__ import annotations

import pytest

from learnlens.functions.literals import literal_rows
from learnlens.session import build_session
from learnlens.sources.tables import SCHEMAS, LearningTables


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "learnlens-tests",
        **{
            "spark.sql.shuffle.partitions": "2",
            # Tiny inputs: compiling generated code would take most of the time.
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
            # over a hundred plans in one session
            "spark.driver.memory": "4g",
            "spark.sql.ui.retainedExecutions": "10",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ROLES = [(3, "editingteacher"), (4, "teacher"), (5, "student")]
STUDENT, TEACHER = 5, 4


@pytest.fixture
def world(spark):
    """Build tables from short row lists; anything left out is empty. Columns follow `SCHEMAS`.

    `enrolments` are (user, course, role); courses are (id, start, end).
    """

    def build(courses=(), enrolments=(), **rows) -> LearningTables:
        rows = {
            "course": [(c, f"course {c}", start, end) for c, start, end in courses],
            "context": [(1000 + c, 50, c) for c, _, _ in courses],
            "role": ROLES,
            "role_assignments": [(n, user, 1000 + c, role) for n, (user, c, role) in enumerate(enrolments)],
            **rows,
        }
        # Literal tables keep the many small cases free of Python workers.
        return LearningTables.from_reader(
            lambda name: literal_rows(spark, rows.get(name, []), SCHEMAS[name].simpleString()[len("struct<"):-1].replace(":", " "))
        )

    return build


LOGIN = r"\core\event\user_loggedin"
COURSE_VIEW = r"\core\event\course_viewed"
MODULES = ("forum", "assign", "resource", "url", "page", "lesson")


def event(id, user, course, time, kind="course", *, object=1, module=10, component=None, action=None):
    """A log row by short kind: login, course, discussion, submit, profile, or a module name for its view."""
    name, part, what = {
        "login": (LOGIN, "core", "loggedin"),
        "course": (COURSE_VIEW, "core", "viewed"),
        "discussion": (r"\mod_forum\event\discussion_viewed", "mod_forum", "viewed"),
        "submit": (r"\mod_assign\event\assessable_submitted", "mod_assign", "submitted"),
        "profile": (r"\core\event\user_profile_viewed", "core", "viewed"),
        **{m: (rf"\mod_{m}\event\course_module_viewed", f"mod_{m}", "viewed") for m in MODULES},
    }[kind]
    return (id, user, course, name, component or part, action or what, object, module, time)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def states(df):
    return {(r.student_id, r.course_id): r.state for r in df.collect()}
