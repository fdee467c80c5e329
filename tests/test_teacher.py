"""Hand-made cases for the teacher indicators."""

import pytest

from learnlens.functions.text import IMPROVEMENT_KEYWORDS, RESOLUTION_KEYWORDS, contains_any
from learnlens.operators.states import EXHIBITED, NOT_EXHIBITED, NOT_REQUIRED
from learnlens.operators.uniqueness import feedback_uniqueness, unique_feedback
from learnlens.operators.weekly import weekly_interactions
from learnlens.plans import teacher
from tests.conftest import STUDENT, TEACHER, event, states

DAY, WEEK = 86400, 604800
COURSE = [(1, 0, 100 * DAY)]


def submitted(id, user, time=1000, assignment=10, attempt=0):
    return (id, assignment, user, time, time, "submitted", attempt, 1)


def graded(id, user, grade=80.0, time=2000, assignment=10, attempt=0):
    return (id, assignment, user, attempt, grade, time)


@pytest.fixture
def classroom(world):
    """Students 1..n in course 1 with one assignment (10)."""

    def build(submissions, grades=(), comments=(), students=(1, 2, 3), courses=COURSE, **more):
        return world(
            courses, [(u, 1, STUDENT) for u in students], assign=[(10, 1)], assign_submission=submissions,
            assign_grades=list(grades), assignfeedback_comments=list(comments), **more,
        )

    return build


# -- feedback on low grades


def test_grade_cutoff_is_strict_and_raw(classroom):
    t = classroom(
        [submitted(1, 1), submitted(2, 2), submitted(3, 3)],
        [graded(1, 1, 70.0), graded(2, 2, 60.0), graded(3, 3, -1.0)],
        [(1, 10, 2, "Please Review this")],
    )
    assert states(teacher.course_performance_feedback(t)) == {
        (1, 1): NOT_REQUIRED, (2, 1): EXHIBITED, (3, 1): NOT_EXHIBITED,
    }


def test_one_good_comment_is_enough_and_null_grades_are_skipped(world):
    t = world(
        COURSE, [(1, 1, STUDENT), (2, 1, STUDENT)], assign=[(10, 1), (11, 1)],
        assign_submission=[submitted(1, 1), submitted(2, 1, assignment=11), submitted(3, 2)],
        assign_grades=[graded(1, 1, 10.0), graded(2, 1, 20.0, assignment=11), graded(3, 2, None)],
        assignfeedback_comments=[(1, 10, 1, "well"), (2, 11, 2, "see the RUBRIC"), (3, 10, 3, "focus")],
    )
    assert states(teacher.course_performance_feedback(t)) == {(1, 1): EXHIBITED, (2, 1): NOT_REQUIRED}


@pytest.mark.parametrize(
    ("text", "found"),
    [("THANK YOU", True), ("thanK you", False), ("", False), (None, False), ("makes  sense", False),
     ("so it MaKeS sense", True), ("appreciated", True)],
)
def test_keywords_ignore_ascii_case_only(spark, text, found):
    df = spark.createDataFrame([(text,)], "message string")
    assert df.select(contains_any(df.message, RESOLUTION_KEYWORDS).alias("x")).collect()[0].x is found


def test_many_keywords_are_found_in_one_pass(spark):
    """The same rows as by plain search, at every place of a keyword and with letters whose lower case is ASCII."""
    texts = [None, "", "nothing here", "wor on", "edi t", "in\ncorrec\nt", "E\u212aeep practicing", "\u0130mprove", "Iimprov e", "seek  assistance", "a.b", "axb"]
    for word in (*IMPROVEMENT_KEYWORDS, "a.b", "x*"):
        texts += [word, word.upper(), f"so\n{word.title()}ly é", word[:-1], word[1:], word.replace("k", "\u212a").replace("s", "\u017f")]
    df = spark.createDataFrame([(x,) for x in texts], "message string")
    for keywords in (IMPROVEMENT_KEYWORDS, (*IMPROVEMENT_KEYWORDS, "a.b", "x*")):
        held = [any(k in "".join(c.lower() if c.isascii() else c for c in x or "") for k in keywords) for x in texts]
        assert [r.x for r in df.select(contains_any(df.message, keywords).alias("x")).collect()] == held
        assert "RLIKE" in df.select(contains_any(df.message, keywords))._jdf.queryExecution().optimizedPlan().toString()
    assert not df.select(contains_any(df.message, [*IMPROVEMENT_KEYWORDS, "über"]))._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")


# -- personalised feedback


def uniqueness(t):
    return {r.student_id: round(r.uniqueness, 6) for r in feedback_uniqueness(t).collect()}


def test_missing_comment_among_real_ones(classroom):
    t = classroom([submitted(1, 1), submitted(2, 2)], [graded(1, 1), graded(2, 2)], [(1, 10, 1, None), (2, 10, 2, "good work")])
    assert uniqueness(t) == {1: 1.0, 2: 1.0}
    assert states(teacher.personalized_feedback(t)) == {(1, 1): EXHIBITED, (2, 1): EXHIBITED, (3, 1): NOT_REQUIRED}


def test_two_missing_comments_match(classroom):
    t = classroom([submitted(1, 1), submitted(2, 2)])
    assert uniqueness(t) == {1: 0.0, 2: 0.0}
    assert states(teacher.personalized_feedback(t))[(1, 1)] == NOT_EXHIBITED


def test_repeated_words_count(classroom):
    t = classroom([submitted(1, 1), submitted(2, 2)], [graded(1, 1), graded(2, 2)], [(1, 10, 1, "a a b"), (2, 10, 2, "a c")])
    assert uniqueness(t) == {1: round(1 - 2 / 3, 6), 2: 0.5}


def test_goal_tie_is_unique_enough(classroom):
    t = classroom([submitted(1, 1), submitted(2, 2)], [graded(1, 1), graded(2, 2)], [(1, 10, 1, "a b c d e"), (2, 10, 2, "a b x y z")])
    assert states(teacher.personalized_feedback(t, feedbackgoal=60.0))[(1, 1)] == EXHIBITED
    assert states(teacher.personalized_feedback(t, feedbackgoal=61.0))[(1, 1)] == NOT_EXHIBITED


def test_two_records_of_one_student_are_compared(classroom):
    t = classroom([submitted(1, 1)], [graded(1, 1), graded(2, 1)], [(1, 10, 1, "same words"), (2, 10, 2, "same words")])
    assert [r.uniqueness for r in feedback_uniqueness(t).collect()] == [0.0, 0.0]


def test_a_comment_id_with_two_texts_multiplies_no_record(classroom):
    t = classroom([submitted(1, 1), submitted(2, 2)], [graded(1, 1), graded(2, 2)], [(5, 10, 1, "a b"), (5, 10, 1, "a c d"), (6, 10, 2, "e f")])
    keys = sorted(r.record_key for r in unique_feedback(t, 60.0).collect())
    assert keys == sorted(r.record_key for r in feedback_uniqueness(t).collect()) == [5, 5, 6]


def test_newlines_do_not_split_and_double_spaces_make_empty_words(classroom):
    t = classroom([submitted(1, 1), submitted(2, 2)], [graded(1, 1), graded(2, 2)], [(1, 10, 1, "a\nb  c"), (2, 10, 2, "a  d")])
    assert uniqueness(t) == {1: round(1 - 1 / 3, 6), 2: round(1 - 1 / 3, 6)}


# -- timely feedback


@pytest.mark.parametrize(
    ("grade_time", "expected"),
    [(1000 + 8 * DAY, EXHIBITED), (1001 + 8 * DAY, NOT_EXHIBITED), (999, NOT_EXHIBITED), (1000, EXHIBITED), (0, NOT_EXHIBITED)],
)
def test_deadline(classroom, grade_time, expected):
    t = classroom([submitted(1, 1)], [graded(1, 1, time=grade_time)])
    assert states(teacher.timely_feedback(t))[(1, 1)] == expected


def test_any_grade_row_is_feedback_and_a_missing_one_is_late(classroom):
    t = classroom([submitted(1, 1), submitted(2, 2)], [graded(1, 1, -1.0, time=1000 + DAY)])
    assert states(teacher.timely_feedback(t)) == {(1, 1): EXHIBITED, (2, 1): NOT_EXHIBITED, (3, 1): NOT_REQUIRED}


def test_one_late_grade_among_several_is_late(classroom):
    t = classroom([submitted(1, 1)], [graded(1, 1, time=1500), graded(2, 1, time=1000 + 9 * DAY)])
    assert states(teacher.timely_feedback(t))[(1, 1)] == NOT_EXHIBITED


def test_grade_after_course_end_and_other_attempts_do_not_count(classroom):
    t = classroom(
        [submitted(1, 1, time=1000), submitted(2, 2)], [graded(1, 1, time=2000), graded(2, 2, time=1500, attempt=1)],
        courses=[(1, 0, 1800)],
    )
    assert states(teacher.timely_feedback(t)) == {(1, 1): NOT_EXHIBITED, (2, 1): NOT_EXHIBITED, (3, 1): NOT_REQUIRED}


# -- forums


def forum(world, posts, enrolments=((1, 1, STUDENT), (2, 1, STUDENT), (9, 1, TEACHER))):
    return world(COURSE, list(enrolments), forum_discussions=[(5, 1)], forum_posts=[(i, 5, parent, user, 100 + i, text) for i, parent, user, text in posts])


def test_resolved_chain(world):
    t = forum(world, [(1, 0, 1, "help"), (2, 1, 9, "try"), (3, 2, 1, "That WORKED"), (4, 0, 2, "me too, thanks")])
    assert states(teacher.monitoring_forums(t)) == {(1, 1): EXHIBITED, (2, 1): NOT_EXHIBITED}


def test_follow_up_by_another_student(world):
    t = forum(world, [(1, 0, 1, "help"), (2, 1, 9, "try"), (3, 2, 2, "thanks")])
    assert states(teacher.monitoring_forums(t)) == {(1, 1): NOT_EXHIBITED, (2, 1): NOT_EXHIBITED}


def test_no_post_is_not_required_and_null_message_resolves_nothing(world):
    t = forum(world, [(1, 0, 1, "help"), (2, 1, 9, "try"), (3, 2, 1, None)])
    assert states(teacher.monitoring_forums(t)) == {(1, 1): NOT_EXHIBITED, (2, 1): NOT_REQUIRED}


def test_dual_role_is_both(world):
    t = forum(world, [(1, 0, 1, "help"), (2, 1, 1, "own answer"), (3, 2, 1, "all set")], [(1, 1, STUDENT), (1, 1, TEACHER)])
    assert states(teacher.monitoring_forums(t)) == {(1, 1): EXHIBITED}


# -- weekly use


def weekly_log(user, counts, first=1):
    return [event(first + 100 * week + i, user, 1, week * WEEK + 10 + i) for week, n in enumerate(counts) for i in range(n)]


def test_highest_teacher_id_decides(world):
    members = [(1, 1, STUDENT), (7, 1, TEACHER), (9, 1, TEACHER)]
    t = world([(1, 0, 2 * WEEK)], members, logstore_standard_log=weekly_log(7, (5, 5)) + weekly_log(9, (5, 4), 5000))
    assert states(teacher.consistent_use_lms(t, 10 * WEEK)) == {(1, 1): NOT_EXHIBITED}


def test_every_week_not_the_average(world):
    t = world([(1, 0, 2 * WEEK)], [(1, 1, STUDENT), (7, 1, TEACHER)], logstore_standard_log=weekly_log(7, (10, 0)))
    assert states(teacher.consistent_use_lms(t, 10 * WEEK)) == {(1, 1): NOT_EXHIBITED}
    assert [(r.week, r.interactions) for r in weekly_interactions(t, 10 * WEEK).orderBy("week").collect()] == [(0, 10), (1, 0)]


def test_views_count_and_open_course_ends_now(world):
    t = world([(1, 0, 0)], [(1, 1, STUDENT), (7, 1, TEACHER)], logstore_standard_log=weekly_log(7, (5, 5)))
    assert states(teacher.consistent_use_lms(t, 2 * WEEK)) == {(1, 1): EXHIBITED}


def test_future_weeks_are_empty(world):
    t = world([(1, 0, 3 * WEEK)], [(1, 1, STUDENT), (7, 1, TEACHER)], logstore_standard_log=weekly_log(7, (5, 5)))
    assert states(teacher.consistent_use_lms(t, 2 * WEEK)) == {(1, 1): NOT_EXHIBITED}


def test_course_that_ends_before_it_starts_has_one_slot(world):
    t = world([(1, 500, 400)], [(1, 1, STUDENT), (7, 1, TEACHER)])
    assert states(teacher.consistent_use_lms(t, 2 * WEEK, interactionthreshold=1)) == {(1, 1): NOT_EXHIBITED}
    assert states(teacher.consistent_use_lms(t, 2 * WEEK, interactionthreshold=0)) == {(1, 1): EXHIBITED}


def test_no_teacher(world):
    assert states(teacher.consistent_use_lms(world(COURSE, [(1, 1, STUDENT)]), WEEK)) == {(1, 1): NOT_EXHIBITED}
