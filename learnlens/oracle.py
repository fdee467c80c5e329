"""DuckDB SQL for every registered query: the independent side of the correctness check.

The tables are derived from the same Parquet views by the same fixed mapping, then each query is written in the
plainest relational form (EXISTS for logins, pairwise comparison of feedback, generated week slots), not in the form
the Spark jobs use.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from learnlens.sources.sample import AS_OF, T0

# Written down here once more, so that an error in the engine's lists is no error on both sides.
# Words that show a forum question was resolved.
RESOLUTION_KEYWORDS = (
    "thanks", "thank you", "appreciate", "appreciated", "helpful", "that worked", "works now", "fixed it",
    "problem solved", "issue resolved", "makes sense", "clears it up", "answers my question", "all good now",
    "all set",
)

# Words that show feedback tells a student how to improve.
IMPROVEMENT_KEYWORDS = (
    "improve", "work on", "focus", "strengthen", "revise", "organization", "learning objects", "textbook",
    "materials", "review", "understanding", "explain", "detail", "specific", "example", "evidence", "analysis",
    "accuracy", "correct", "incorrect", "error", "mistake", "missing", "incomplete", "complete", "requirements",
    "instructions", "rubric", "criteria", "grammar", "spelling", "punctuation", "sentence structure",
    "word choice", "proofread", "edit", "citation", "reference", "formatting", "effort", "practice", "study",
    "prepare", "participate", "participation", "time management", "ask for help", "seek assistance", "next time",
    "next step", "try to", "you should", "consider", "recommend", "suggest", "make sure", "remember to",
    "continue working", "keep practicing",
)

# The indicators in display order, with name, group, success flag and control.
BLOCKS = (
    ("course_performance_feedback", "Messaging Struggling Students (Low Grades)", "teacher", True, None),
    ("personalized_feedback", "Personalized Feedback", "teacher", True, None),
    ("timely_feedback", "Timely Feedback", "teacher", False, None),
    ("monitoring_forums", "Monitoring Forums", "teacher", False, None),
    ("consistent-use-lms", "Consistent Use of LMS", "teacher", False, None),
    ("login_frequency", "Login frequency", "student", False, None),
    ("student_active_time", "Student active time", "student", True, "time_range"),
    ("time_spent_forums", "Time spent viewing forums", "student", True, "time_range"),
    ("time_spent_assignments", "Time spent on assignments", "student", False, "time_range"),
    ("lo_access_frequency", "Learning object access frequency", "student", False, None),
    ("forum_posting_frequency", "Forum posting frequency", "student", True, None),
    ("time_spent_lo", "Time spent accessing learning objects", "student", True, "time_range"),
    ("number_forums_viewed", "Number of forums viewed", "student", True, None),
)

# Starts of the reporting periods before the fixed clock 2024-01-31 00:00 UTC: 2024-01-30 23:00, 2024-01-30, 2024-01-24, 2023-12-31, 2023-01-31.
PERIOD_STARTS = {"hourly": 1706655600, "daily": 1706572800, "weekly": 1706054400, "monthly": 1703980800, "yearly": 1675123200}

PLACE = "((userid + 7 * (n % 3)) % 25 + 1)"

# name -> (needed names, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "course": ((), f"""
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS shortname,
               CAST({T0} + (n_nationkey % 3) * 86400 - CASE WHEN n_nationkey % 4 = 3 THEN 250 * 86400 ELSE 0 END AS BIGINT) AS startdate,
               CAST(CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE {T0} + (21 + n_nationkey % 14) * 86400 END AS BIGINT) AS enddate
        FROM nation"""),
    "context": (("course",), "SELECT 1000 + id AS id, 50 AS contextlevel, id AS instanceid FROM course"),
    "role": ((), "SELECT * FROM (VALUES (3, 'editingteacher'), (4, 'teacher'), (5, 'student')) AS r(id, shortname)"),
    "role_assignments": ((), """
        SELECT u * 10 + j AS id, u AS userid, 1001 + (u + 7 * j) % 25 AS contextid,
               CASE WHEN u % 10 = 0 THEN 3 WHEN u % 5 = 0 THEN 4 ELSE 5 END AS roleid
        FROM (SELECT DISTINCT user_id AS u FROM events) AS people, (VALUES (0), (1), (2)) AS nth(j)
        UNION ALL
        SELECT u * 10 + 3, u, 1001 + u % 25, 4 FROM (SELECT DISTINCT user_id AS u FROM events) AS people WHERE u % 20 = 1
        UNION ALL
        SELECT u * 10 + 4, u, 1001 + u % 25, 5 FROM (SELECT DISTINCT user_id AS u FROM events) AS people WHERE u % 10 = 2"""),
    "log": ((), f"""
        SELECT n AS id, userid, CASE WHEN event_type = 'signup' THEN 0 ELSE {PLACE} END AS courseid,
               CASE event_type
                 WHEN 'signup' THEN '\\core\\event\\user_loggedin'
                 WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN '\\core\\event\\course_viewed' ELSE '\\mod_forum\\event\\discussion_viewed' END
                 WHEN 'view' THEN '\\' || module || '\\event\\course_module_viewed'
                 WHEN 'purchase' THEN '\\mod_assign\\event\\assessable_submitted'
                 ELSE '\\core\\event\\user_profile_viewed' END AS eventname,
               CASE event_type
                 WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'core' ELSE 'mod_forum' END
                 WHEN 'view' THEN module WHEN 'purchase' THEN 'mod_assign' ELSE 'core' END AS component,
               CASE event_type WHEN 'signup' THEN 'loggedin' WHEN 'purchase' THEN 'submitted' ELSE 'viewed' END AS action,
               CAST(k % 10 AS BIGINT) AS objectid, {PLACE} * 10 + k % 4 AS contextinstanceid, timecreated
        FROM (SELECT *, ['mod_forum', 'mod_assign', 'mod_resource', 'mod_url', 'mod_page', 'mod_lesson'][k % 6 + 1] AS module
              FROM (SELECT event_id AS n, user_id AS userid, event_type,
                           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                           CAST(CASE event_id % 10 WHEN 3 THEN {AS_OF} - event_id * 37 % 3600 WHEN 6 THEN {AS_OF} - event_id * 7919 % 86400
                                WHEN 9 THEN floor(epoch(ts)) - 86400 * (40 + event_id // 10 % 200) ELSE floor(epoch(ts)) END AS BIGINT) AS timecreated
                    FROM events) AS parsed) AS named"""),
    "assign": (("course",), "SELECT id * 10 + a AS id, id AS course FROM course, (VALUES (0), (1), (2), (3)) AS nth(a)"),
    "assign_submission": ((), f"""
        SELECT n + 1 AS id, n, assignment, userid, timecreated, timecreated + 3600 * (n % 5) AS timemodified, status, total,
               row_number() OVER (PARTITION BY userid, assignment ORDER BY n) - 1 AS attemptnumber,
               CASE WHEN n = max(n) OVER (PARTITION BY userid, assignment) THEN 1 ELSE 0 END AS latest
        FROM (SELECT n, userid, {PLACE} * 10 + (n // 3) % 4 AS assignment, status, total,
                     CAST({T0} + (days % 30) * 86400 + n % 86400 AS BIGINT) AS timecreated
              FROM (SELECT o_orderkey AS n, o_custkey // 10 AS userid, o_totalprice AS total,
                           CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'submitted' END AS status,
                           date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days
                    FROM orders) AS placed) AS timed"""),
    "assign_grades": (("assign_submission",), """
        SELECT id, n, assignment, userid, attemptnumber, CAST(CAST(floor(total) AS BIGINT) % 101 AS DOUBLE) AS grade,
               timemodified + (n % 12) * 86400 AS timemodified
        FROM assign_submission WHERE n % 7 <> 0"""),
    "comments": (("assign_grades",), """
        SELECT 2 * id + copy AS id, assignment, id AS grade,
               text || CASE n % 4 WHEN 0 THEN ' Please REVIEW the rubric' WHEN 1 THEN ' keep it up'
                                  WHEN 2 THEN ' Focus on detail' ELSE '' END AS commenttext
        FROM (SELECT *, 0 AS copy, n // 15 AS document FROM assign_grades WHERE n % 5 <> 0
              UNION ALL SELECT *, 1, n // 7 FROM assign_grades WHERE n % 7 = 1) AS written
        JOIN documents ON doc_id = document"""),
    "forum_discussions": ((), "SELECT DISTINCT conv_id + 1 AS id, conv_id % 25 + 1 AS course FROM conversations"),
    "members": (("role_assignments",), """
        SELECT course, kind, userid, row_number() OVER (PARTITION BY course, kind ORDER BY userid) AS place,
               count(*) OVER (PARTITION BY course, kind) AS members
        FROM (SELECT DISTINCT contextid - 1000 AS course, CASE WHEN roleid = 5 THEN 'user' ELSE 'assistant' END AS kind, userid
              FROM role_assignments) AS distinct_members"""),
    "forum_posts": (("members",), f"""
        SELECT conv_id * 10 + turn + 1 AS id, conv_id + 1 AS discussion,
               CASE WHEN turn = 0 THEN 0 ELSE conv_id * 10 + turn END AS parent, coalesce(userid, -1 - conv_id) AS userid,
               {T0} + (conv_id * 18000) % (28 * 86400) + turn * 600 AS created,
               text || CASE WHEN c.role <> 'user' OR turn < 2 THEN '' WHEN conv_id % 3 = 0 THEN ' Thanks, that WORKED'
                            WHEN conv_id % 3 = 1 THEN ' still stuck' ELSE '' END AS message
        FROM conversations c LEFT JOIN members m
          ON m.course = conv_id % 25 + 1 AND m.kind = c.role AND m.place = (conv_id // 25) % m.members + 1"""),
    # Steps shared by several queries.
    "holders": (("course", "context", "role_assignments", "role"), """
        SELECT a.userid, c.id AS course_id, c.startdate AS course_start, c.enddate AS course_end, r.shortname
        FROM course c JOIN context x ON x.instanceid = c.id AND x.contextlevel = 50
        JOIN role_assignments a ON a.contextid = x.id JOIN role r ON r.id = a.roleid"""),
    "roster": (("holders",), """
        SELECT DISTINCT userid AS student_id, course_id, course_start, course_end FROM holders WHERE shortname = 'student'"""),
    "open_roster": (("roster",), f"""
        SELECT student_id, course_id, course_start,
               CASE WHEN course_end = 0 THEN {AS_OF} ELSE course_end END AS course_end FROM roster"""),
    "teachers": (("holders",), f"""
        SELECT DISTINCT userid AS teacher_id, course_id, course_start,
               CASE WHEN course_end = 0 THEN {AS_OF} ELSE course_end END AS course_end
        FROM holders WHERE shortname IN ('editingteacher', 'teacher')"""),
    "participants": (("holders",), """
        SELECT userid AS author_id, course_id, course_start, course_end,
               CAST(max(CASE WHEN shortname = 'student' THEN 1 ELSE 0 END) AS INTEGER) AS author_is_student,
               CAST(max(CASE WHEN shortname <> 'student' THEN 1 ELSE 0 END) AS INTEGER) AS author_is_teacher
        FROM holders GROUP BY ALL"""),
    "login_access": (("log", "open_roster"), """
        SELECT DISTINCT l.userid AS student_id, l.id AS login_id, l.timecreated AS login_time, s.course_id
        FROM (SELECT *, lead(timecreated) OVER (PARTITION BY userid ORDER BY timecreated, id) AS next_login
              FROM log WHERE eventname = '\\core\\event\\user_loggedin') AS l
        JOIN open_roster s ON s.student_id = l.userid AND l.timecreated BETWEEN s.course_start AND s.course_end
        WHERE EXISTS (SELECT 1 FROM log v
                      WHERE v.userid = l.userid AND v.courseid = s.course_id AND v.eventname = '\\core\\event\\course_viewed'
                        AND v.timecreated >= l.timecreated AND (l.next_login IS NULL OR v.timecreated < l.next_login))"""),
    "latest_submissions": (("assign_submission", "assign", "roster"), """
        SELECT s.id AS submission_id, s.assignment AS assignment_id, s.userid AS student_id, a.course AS course_id,
               r.course_start, r.course_end, s.attemptnumber AS attempt_number, s.timemodified AS submission_date
        FROM assign_submission s JOIN assign a ON a.id = s.assignment
        JOIN roster r ON r.student_id = s.userid AND r.course_id = a.course
        WHERE s.latest = 1 AND s.status = 'submitted' AND s.timecreated < r.course_end
          AND s.timemodified >= r.course_start AND s.timemodified < r.course_end"""),
    "graded": (("latest_submissions", "assign_grades"), """
        SELECT s.*, g.id AS grade_id, g.grade, g.timemodified AS graded_date
        FROM latest_submissions s LEFT JOIN assign_grades g
          ON g.assignment = s.assignment_id AND g.userid = s.student_id AND g.attemptnumber = s.attempt_number
         AND g.timemodified < s.course_end"""),
    "feedback": (("graded", "comments"), """
        SELECT g.*, c.id AS feedback_id, c.commenttext AS feedback_text
        FROM graded g LEFT JOIN comments c ON c.assignment = g.assignment_id AND c.grade = g.grade_id"""),
    "scored": (("feedback",), """
        SELECT a.course_id, a.assignment_id, a.student_id, a.submission_id,
               coalesce(a.feedback_id, -a.submission_id) AS record_key, CAST(len(a.own) AS BIGINT) AS n_words,
               CAST(coalesce(max(len([w for w in a.own if list_contains(b.own, w)])), 0) AS BIGINT) AS overlap
        FROM (SELECT *, row_number() OVER () AS nr, string_split(coalesce(feedback_text, ''), ' ') AS own FROM feedback) AS a
        LEFT JOIN (SELECT assignment_id, submission_id, feedback_id, grade_id,
                          list_distinct(string_split(coalesce(feedback_text, ''), ' ')) AS own FROM feedback) AS b
          ON b.assignment_id = a.assignment_id
         AND (b.submission_id, coalesce(b.grade_id, -1), coalesce(b.feedback_id, -1))
             <> (a.submission_id, coalesce(a.grade_id, -1), coalesce(a.feedback_id, -1))
        GROUP BY a.nr, a.course_id, a.assignment_id, a.student_id, a.submission_id, a.feedback_id, a.own"""),
    "posts": (("forum_posts", "forum_discussions", "participants"), """
        SELECT p.id AS post_id, p.parent AS parent_post_id, d.course AS course_id, p.userid AS author_id,
               m.author_is_student, m.author_is_teacher, p.message
        FROM forum_posts p JOIN forum_discussions d ON d.id = p.discussion
        JOIN participants m ON m.author_id = p.userid AND m.course_id = d.course
        WHERE p.created >= m.course_start AND p.created < m.course_end"""),
    "chains": (("posts",), f"""
        SELECT DISTINCT question.author_id AS student_id, question.course_id
        FROM posts question
        JOIN posts reply ON reply.course_id = question.course_id AND reply.parent_post_id = question.post_id
        JOIN posts followup ON followup.course_id = reply.course_id AND followup.parent_post_id = reply.post_id
        WHERE question.author_is_student = 1 AND reply.author_is_teacher = 1 AND followup.author_is_student = 1
          AND followup.author_id = question.author_id AND {{resolved}}"""),
    "weekly": (("teachers", "log"), """
        SELECT teacher_id, course_id, CAST(week AS BIGINT) AS week, count(l.id) AS interactions
        FROM (SELECT *, unnest(range(greatest(1, (greatest(0, course_end - course_start) + 604799) // 604800))) AS week
              FROM teachers) AS slot
        LEFT JOIN log l ON l.userid = teacher_id AND l.courseid = course_id
         AND l.timecreated >= course_start AND l.timecreated < course_end
         AND (l.timecreated - course_start) // 604800 = week
        GROUP BY teacher_id, course_id, week"""),
}


def _holds(column: str, keywords: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{word}')" for word in keywords) + ")"


_CTES["chains"] = (
    _CTES["chains"][0],
    _CTES["chains"][1].replace("{resolved}", _holds("followup.message", RESOLUTION_KEYWORDS)),
)


def with_steps(needed: Iterable[str], select: str, **extra: str) -> str:
    """`select` behind the CTEs it needs, in dependency order; `extra` are further CTEs of the query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _CTES[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needed:
        add(name)
    parts = [f"{name} AS ({_CTES[name][1]})" for name in ordered] + [f"{name} AS ({body})" for name, body in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


# -- student indicators ------------------------------------------------------------------------------------------


#: The month before 2024-01-01 04:00 UTC as a user in New York sees it: from 31 December 23:00 there back to 31 November, which runs on into
#: 1 December 23:00, a day later than in UTC.
IN_NEW_YORK = "monthly in New York"
NEW_YORK_CLOCK = 1704081600


def _window(time_range: str | None) -> tuple[int, int]:
    if time_range == IN_NEW_YORK:
        return 1701489600, NEW_YORK_CLOCK
    return PERIOD_STARTS[time_range or "weekly"], AS_OF


def _events_in_window(time_range: str | None) -> str:
    start, end = _window(time_range)
    return f"""
        SELECT l.id, l.userid AS student_id, l.courseid AS course_id, l.eventname, l.component, l.action, l.objectid,
               l.contextinstanceid, l.timecreated,
               lead(l.timecreated) OVER (PARTITION BY l.userid, l.courseid ORDER BY l.timecreated, l.id) AS next_time
        FROM log l JOIN roster r ON r.student_id = l.userid AND r.course_id = l.courseid
        WHERE l.timecreated BETWEEN r.course_start AND r.course_end AND l.timecreated BETWEEN {start} AND {end}"""


def _module_views(*modules: str) -> str:
    return ", ".join(f"'\\mod_{module}\\event\\course_module_viewed'" for module in modules)


def student_totals(indicator_id: str, time_range: str | None = None, cap: int = 1800) -> tuple[tuple[str, ...], str, dict[str, str]]:
    """(needed steps, SQL giving student_id, course_id, total, further steps). Missing pairs are filled later."""
    gap = f"least(next_time - timecreated, {cap})"  # DuckDB's least skips nulls, so callers guard
    timed = {"gaps": _events_in_window(time_range)}
    start, end = _window(time_range)
    if indicator_id == "student_active_time":
        active = "(component LIKE 'mod_%' OR eventname = '\\core\\event\\course_viewed')"
        return ("log", "roster"), f"""
            SELECT student_id, course_id, CAST(sum(CASE WHEN NOT {active} THEN 0 WHEN next_time IS NULL THEN NULL ELSE {gap} END) AS BIGINT) AS total
            FROM gaps GROUP BY ALL""", timed
    if indicator_id == "time_spent_forums":
        return ("log", "roster"), f"""
            SELECT student_id, course_id, CAST(sum(CASE WHEN next_time IS NULL THEN 0 ELSE {gap} END) AS BIGINT) AS total
            FROM gaps WHERE component = 'mod_forum' AND action = 'viewed' GROUP BY ALL""", timed
    if indicator_id == "time_spent_lo":
        return ("log", "roster"), f"""
            SELECT student_id, course_id, CAST(sum(least(coalesce(next_time - timecreated, 0), {cap})) AS BIGINT) AS total
            FROM gaps WHERE eventname IN ({_module_views('resource', 'url', 'page', 'lesson')}) GROUP BY ALL""", timed
    if indicator_id == "time_spent_assignments":
        return ("log", "roster"), """
            SELECT student_id, course_id, CAST(sum(assignment_time_seconds) AS BIGINT) AS total FROM durations GROUP BY ALL
            """, assignment_steps(start, end)
    if indicator_id == "lo_access_frequency":
        return ("log", "roster"), f"""
            SELECT userid AS student_id, courseid AS course_id, count(id) AS total FROM log
            WHERE eventname IN ({_module_views('forum', 'assign', 'resource', 'url', 'page', 'lesson')}) GROUP BY ALL""", {}
    if indicator_id == "forum_posting_frequency":
        return ("forum_posts", "forum_discussions", "roster"), """
            SELECT p.userid AS student_id, d.course AS course_id, count(p.id) AS total
            FROM forum_posts p JOIN forum_discussions d ON d.id = p.discussion GROUP BY ALL""", {}
    if indicator_id == "number_forums_viewed":
        return ("log", "roster"), """
            SELECT userid AS student_id, courseid AS course_id, count(DISTINCT objectid) AS total FROM log
            WHERE eventname = '\\mod_forum\\event\\discussion_viewed' GROUP BY ALL""", {}
    raise KeyError(indicator_id)


def assignment_steps(start: int, end: int) -> dict[str, str]:
    return {
        "views": f"""
            SELECT r.student_id, r.course_id, r.course_end, l.contextinstanceid AS module_id, min(l.timecreated) AS first_view_time
            FROM roster r JOIN log l ON l.userid = r.student_id AND l.courseid = r.course_id
            WHERE l.eventname = '\\mod_assign\\event\\course_module_viewed'
              AND l.timecreated BETWEEN r.course_start AND r.course_end AND l.timecreated BETWEEN {start} AND {end}
            GROUP BY ALL""",
        "durations": f"""
            SELECT v.student_id, v.course_id, v.module_id, v.first_view_time,
                   coalesce(min(l.timecreated) - v.first_view_time, 0) AS assignment_time_seconds
            FROM views v LEFT JOIN log l
              ON l.userid = v.student_id AND l.courseid = v.course_id AND l.contextinstanceid = v.module_id
             AND l.eventname = '\\mod_assign\\event\\assessable_submitted'
             AND l.timecreated >= v.first_view_time AND l.timecreated <= v.course_end AND l.timecreated <= {end}
            GROUP BY v.student_id, v.course_id, v.module_id, v.first_view_time""",
    }


VALUES = {
    "login_frequency": "login_frequency",
    "student_active_time": "active_time_seconds",
    "time_spent_forums": "total_seconds_spent",
    "time_spent_assignments": "assignment_time_seconds",
    "lo_access_frequency": "learning_object_access_frequency",
    "forum_posting_frequency": "forum_post_frequency",
    "time_spent_lo": "learning_object_view_time_seconds",
    "number_forums_viewed": "forums_viewed_count",
}
# Number order, sort order.
ORDERS = {
    "student_active_time": ("course_id, student_id", "student_id, course_id"),
    "time_spent_forums": ("student_id, course_id", "student_id, course_id"),
    "time_spent_assignments": ("student_id, course_id", "student_id, course_id"),
    "lo_access_frequency": ("course_id, student_id", "student_id, course_id"),
    "forum_posting_frequency": ("course_id, student_id", "course_id, student_id"),
    "time_spent_lo": ("course_id, student_id", "course_id, student_id"),
    "number_forums_viewed": ("course_id, student_id", "course_id, student_id"),
}
HOURS = ("student_active_time", "time_spent_forums", "time_spent_assignments", "time_spent_lo")


def _filled(indicator_id: str) -> str:
    """Rows student_id, course_id, total over the CTE `totals`."""
    if indicator_id == "time_spent_forums":
        return "SELECT student_id, course_id, total FROM totals JOIN (SELECT DISTINCT student_id, course_id FROM roster) AS r USING (student_id, course_id)"
    return """SELECT r.student_id, r.course_id, coalesce(total, 0) AS total FROM roster r
              LEFT JOIN totals ON totals.student_id = r.student_id AND totals.course_id = r.course_id"""


def _login_counts() -> str:
    return """SELECT s.student_id, count(DISTINCT a.login_id) AS total FROM (SELECT DISTINCT student_id FROM roster) AS s
              LEFT JOIN login_access a ON a.student_id = s.student_id GROUP BY s.student_id"""


def student_indicator(indicator_id: str, time_range: str | None = None, cap: int = 1800) -> str:
    if indicator_id == "login_frequency":
        return with_steps(("login_access", "roster"), "SELECT student_id, total AS login_frequency FROM filled", filled=_login_counts())
    needed, totals, extra = student_totals(indicator_id, time_range, cap)
    number, _ = ORDERS[indicator_id]
    return with_steps(
        needed,
        f"SELECT row_number() OVER (ORDER BY {number}) AS recordid, student_id, course_id, total AS {VALUES[indicator_id]} FROM filled",
        **extra, totals=totals, filled=_filled(indicator_id),
    )


def _bars(indicator_id: str) -> str:
    order = "student_id" if indicator_id == "login_frequency" else ORDERS[indicator_id][1]
    value = "CAST(ceil(total / 3600.0) AS BIGINT)" if indicator_id in HOURS else "total"
    return f"row_number() OVER (ORDER BY {order}) AS position, CAST(student_id AS VARCHAR) AS label, {value} AS value"


def bar_series(indicator_id: str, time_range: str | None = None) -> str:
    if indicator_id == "login_frequency":
        return with_steps(("login_access", "roster"), f"SELECT {_bars(indicator_id)} FROM filled", filled=_login_counts())
    needed, totals, extra = student_totals(indicator_id, time_range)
    return with_steps(needed, f"SELECT {_bars(indicator_id)} FROM filled", **extra, totals=totals, filled=_filled(indicator_id))


# -- teacher indicators ------------------------------------------------------------------------------------------

_PAIRS = "(SELECT DISTINCT student_id, course_id FROM roster) AS r"


def _folded(evidence: str, fold: str, good: str) -> str:
    """Not Required without evidence; otherwise the any-good (max) or all-good (min) fold of `good`."""
    return f"""
        SELECT r.student_id, r.course_id,
               CASE {fold}(CASE WHEN e.student_id IS NULL THEN NULL WHEN {good} THEN 1 ELSE 0 END)
                 WHEN 1 THEN 'Exhibited' WHEN 0 THEN 'Not Exhibited' ELSE 'Not Required' END AS state
        FROM {_PAIRS} LEFT JOIN ({evidence}) AS e ON e.student_id = r.student_id AND e.course_id = r.course_id
        GROUP BY r.student_id, r.course_id"""


def on_time(days: int) -> str:
    return (
        f"coalesce(submission_date <> 0 AND graded_date <> 0 AND submission_date <= graded_date "
        f"AND graded_date <= submission_date + {days * 86400}, FALSE)"
    )


def teacher_states(indicator_id: str, **p: float) -> tuple[tuple[str, ...], str]:
    if indicator_id == "course_performance_feedback":
        low = f"SELECT * FROM feedback WHERE grade < {p.get('gradethreshold', 70.0)}"
        return ("feedback",), _folded(low, "max", _holds("e.feedback_text", IMPROVEMENT_KEYWORDS))
    if indicator_id == "personalized_feedback":
        goal = float(p.get("feedbackgoal", 60.0)) / 100
        enough = f"NOT (CAST(1.0 AS DOUBLE) - CAST(e.overlap AS DOUBLE) / CAST(e.n_words AS DOUBLE) < CAST({goal!r} AS DOUBLE))"
        return ("scored",), _folded("SELECT * FROM scored", "min", enough)
    if indicator_id == "timely_feedback":
        return ("graded",), _folded("SELECT * FROM graded", "min", on_time(int(p.get("days", 8))))
    if indicator_id == "monitoring_forums":
        evidence = """SELECT author_id AS student_id, course_id, FALSE AS resolved FROM posts WHERE author_is_student = 1
                      UNION ALL SELECT student_id, course_id, TRUE FROM chains"""
        return ("posts", "chains", "roster"), _folded(evidence, "max", "e.resolved")
    if indicator_id == "consistent-use-lms":
        threshold = p.get("interactionthreshold", 5.0)
        return ("weekly", "roster"), f"""
            SELECT r.student_id, r.course_id, coalesce(state, 'Not Exhibited') AS state
            FROM {_PAIRS} LEFT JOIN (
                SELECT course_id, CASE WHEN bool_and(interactions >= {threshold}) THEN 'Exhibited' ELSE 'Not Exhibited' END AS state
                FROM weekly WHERE (course_id, teacher_id) IN (SELECT (course_id, max(teacher_id)) FROM teachers GROUP BY course_id)
                GROUP BY course_id) AS c ON c.course_id = r.course_id"""
    raise KeyError(indicator_id)


def teacher_indicator(indicator_id: str, **p: float) -> str:
    needed, states = teacher_states(indicator_id, **p)
    return with_steps((*needed, "roster"), states)


_SLICES = "(VALUES (1, 'Exhibited'), (2, 'Not Exhibited'), (3, 'Not Required')) AS slice(position, label)"
_PIE = f"""SELECT CAST(position AS BIGINT) AS position, label, (SELECT count(*) FROM states WHERE state = label) AS value FROM {_SLICES}"""


def state_counts(indicator_id: str, **p: float) -> str:
    needed, states = teacher_states(indicator_id, **p)
    return with_steps((*needed, "roster"), _PIE, states=states)


# -- choices -----------------------------------------------------------------------------------------------------


def in_courses(sql: str, course_ids: Iterable[int]) -> str:
    """The same query over some courses: every query takes its courses from the role holders."""
    found = _CTES["holders"][1]
    assert found in sql
    return sql.replace(found, f"{found} WHERE c.id IN ({', '.join(map(str, course_ids))})")


def with_open_end(sql: str) -> str:
    """The same query with open courses ending at the clock."""
    found = "c.enddate AS course_end"
    assert found in sql
    return sql.replace(found, f"CASE WHEN c.enddate = 0 THEN {AS_OF} ELSE c.enddate END AS course_end")


# -- dashboard ---------------------------------------------------------------------------------------------------

_HAS_SOURCE = {
    "course_performance_feedback": "latest_submissions",
    "personalized_feedback": "roster",
    "timely_feedback": "roster",
    "monitoring_forums": "posts",
    "consistent-use-lms": "teachers",
}


def dashboard(group: str | None = None, configured: dict[str, float] | None = None) -> str:
    """`configured` holds settings by the names the teacher queries use, and the session cap."""
    configured = configured or {}
    values = {"days": configured["timelyfeedbackdays"], **configured} if configured else {}
    chosen = [b for b in BLOCKS if group in (None, b[2])]
    needed: list[str] = ["roster"]
    steps: dict[str, str] = {}
    blocks = []
    for i, (indicator_id, name, behaviour_group, success, controlled) in enumerate(chosen, start=1):
        tag = f"i{i}"
        if indicator_id in _HAS_SOURCE:
            names, states = teacher_states(indicator_id, **values)
            needed += [*names, _HAS_SOURCE[indicator_id]]
            steps[f"{tag}_states"] = states
            series = _PIE.replace("FROM states", f"FROM {tag}_states")
            series = f"SELECT * FROM ({series}) AS pie WHERE EXISTS (SELECT 1 FROM {_HAS_SOURCE[indicator_id]})"
        elif indicator_id == "login_frequency":
            needed.append("login_access")
            steps[f"{tag}_filled"] = _login_counts()
            series = f"SELECT {_bars(indicator_id)} FROM {tag}_filled"
        else:
            names, totals, extra = student_totals(indicator_id, cap=int(configured.get("sessioncap", 1800)))
            needed += names
            steps.update(extra)
            steps[f"{tag}_totals"] = totals
            steps[f"{tag}_filled"] = _filled(indicator_id).replace("totals", f"{tag}_totals")
            series = f"SELECT {_bars(indicator_id)} FROM {tag}_filled"
        steps[f"{tag}_series"] = series
        control = f"'{controlled}'" if controlled else "CAST(NULL AS VARCHAR)"
        blocks.append(f"""
            SELECT CAST({i} AS INTEGER) AS display_order, '{indicator_id}' AS indicator_id, '{name}' AS indicator_name,
                   '{behaviour_group}' AS behaviour_group, {success} AS student_success, {control} AS control,
                   s.position IS NOT NULL AS has_data, s.position, s.label, s.value
            FROM (SELECT 1) AS one LEFT JOIN {tag}_series s ON TRUE""")
    return with_steps(needed, "\nUNION ALL\n".join(blocks), **steps)


# -- steps -------------------------------------------------------------------------------------------------------


def steps() -> dict[str, str]:
    start, end = _window("weekly")
    return {
        "course_roster": with_steps(("roster",), "SELECT * FROM roster"),
        "teacher_roster": with_steps(("teachers",), "SELECT * FROM teachers"),
        "course_participants": with_steps(("participants",), "SELECT * FROM participants"),
        "windowed_log": with_steps(
            ("log", "roster"),
            "SELECT id AS event_id, student_id, course_id, eventname, component, action, objectid, contextinstanceid, timecreated FROM gaps",
            gaps=_events_in_window("weekly"),
        ),
        "teacher_events": with_steps(("teachers", "log"), """
            SELECT t.*, l.id AS event_id, l.timecreated AS event_time FROM teachers t LEFT JOIN log l
              ON l.userid = t.teacher_id AND l.courseid = t.course_id
             AND l.timecreated >= t.course_start AND l.timecreated < t.course_end"""),
        "next_event_time": with_steps(
            ("log", "roster"),
            "SELECT id AS event_id, student_id, course_id, timecreated, next_time AS next_event_time FROM gaps",
            gaps=_events_in_window("monthly"),
        ),
        "capped_gaps": with_steps(("log", "roster"), """
            SELECT id AS event_id, student_id, course_id,
                   CASE WHEN next_time - timecreated > 1800 THEN 1800 ELSE next_time - timecreated END AS gap_or_null,
                   CASE WHEN next_time IS NULL THEN 0 WHEN next_time - timecreated > 1800 THEN 1800 ELSE next_time - timecreated END AS gap_or_zero,
                   least(coalesce(next_time - timecreated, 0), 1800) AS least_gap
            FROM gaps""", gaps=_events_in_window("weekly")),
        "login_course_access": with_steps(("login_access",), "SELECT * FROM login_access"),
        "assignment_durations": with_steps(
            ("log", "roster"), "SELECT * FROM durations", **assignment_steps(*_window("monthly"))
        ),
        "latest_submissions": with_steps(("latest_submissions",), "SELECT * FROM latest_submissions"),
        "graded_submissions": with_steps(
            ("graded",), "SELECT submission_id, assignment_id, student_id, course_id, attempt_number, submission_date, grade_id, grade, graded_date FROM graded"
        ),
        "feedback_records": with_steps(
            ("feedback",), "SELECT submission_id, assignment_id, student_id, course_id, grade_id, grade, feedback_id, feedback_text FROM feedback"
        ),
        "improvement_comments": with_steps(
            ("comments",), f"SELECT id AS feedback_id, {_holds('commenttext', IMPROVEMENT_KEYWORDS)} AS has_keyword FROM comments"
        ),
        "resolution_posts": with_steps(
            ("forum_posts",), f"SELECT id AS post_id, {_holds('message', RESOLUTION_KEYWORDS)} AS has_keyword FROM forum_posts"
        ),
        "participant_posts": with_steps(("posts",), f"""
            SELECT post_id, course_id, parent_post_id, author_id, author_is_student, author_is_teacher,
                   {_holds('message', RESOLUTION_KEYWORDS)} AS resolves FROM posts"""),
        "resolved_chains": with_steps(("chains",), "SELECT * FROM chains"),
        "feedback_uniqueness": with_steps(("scored",), """
            SELECT *, CAST(1.0 AS DOUBLE) - CAST(overlap AS DOUBLE) / CAST(n_words AS DOUBLE) AS uniqueness FROM scored"""),
        "feedback_latency": with_steps(("graded",), f"""
            SELECT student_id, course_id, assignment_id, submission_id, submission_date, graded_date,
                   graded_date - submission_date AS latency_seconds, {on_time(8)} AS on_time FROM graded"""),
        "weekly_interactions": with_steps(("weekly",), "SELECT * FROM weekly"),
        "teacher_consistency": with_steps(("weekly",), """
            SELECT teacher_id, course_id, CASE WHEN bool_and(interactions >= 2) THEN 'Exhibited' ELSE 'Not Exhibited' END AS state
            FROM weekly GROUP BY teacher_id, course_id"""),
        "user_courses": with_steps(("role_assignments", "context", "course"), """
            SELECT DISTINCT a.userid AS user_id, c.id AS course_id, c.shortname AS course_name, c.id IN (1, 2, 3) AS selected
            FROM role_assignments a JOIN context x ON x.id = a.contextid AND x.contextlevel = 50 JOIN course c ON c.id = x.instanceid"""),
    }
