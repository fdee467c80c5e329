"""Learning tables derived from the generated benchmark Parquet (events, orders, documents, conversations, nation).

A fixed mapping, the same one as in the SQL oracle, so that every query can be checked on data that grows with the
input. All of it is lazy; nothing is collected and no table is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.functions.literals import literal_rows
from learnlens.operators.numbering import number_within
from learnlens.sources.tables import LearningTables, conform

T0 = 1704067200  # 2024-01-01 00:00 UTC
AS_OF = 1706659200  # 2024-01-31 00:00 UTC, the fixed clock
COURSES = 25


# The second of an event (independent of the session time zone), moved for three events in ten: into the last hour, into the last
# day, or some months back.
_LOG_TIME = f"""case event_id % 10
    when 3 then {AS_OF} - event_id * 37 % 3600
    when 6 then {AS_OF} - event_id * 7919 % 86400
    else timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))
         - if(event_id % 10 = 9, 86400 * (40 + event_id div 10 % 200), 0) end"""


def _e(sql: str) -> Column:
    return F.expr(sql)


def sample_tables(spark: SparkSession, root: str) -> LearningTables:
    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}.parquet")

    course = raw("nation").select(
        _e("cast(n_nationkey + 1 as bigint)").alias("id"),
        F.col("n_name").alias("shortname"),
        # a quarter of the courses began months before
        _e(f"cast({T0} + (n_nationkey % 3) * 86400 - if(n_nationkey % 4 = 3, 250 * 86400, 0) as bigint)").alias("startdate"),
        _e(f"cast(if(n_nationkey % 5 = 0, 0, {T0} + (21 + n_nationkey % 14) * 86400) as bigint)").alias("enddate"),
    )
    role_assignments = _role_assignments(raw("events"))
    discussions = raw("conversations").select("conv_id").distinct().select(
        _e("conv_id + 1").alias("id"), _e(f"conv_id % {COURSES} + 1").alias("course")
    )
    submissions = _submissions(raw("orders"))
    grades = submissions.filter("orderkey % 7 <> 0").select(
        "id", "assignment", "userid", "attemptnumber",
        _e("cast(cast(floor(totalprice) as bigint) % 101 as double)").alias("grade"),
        _e("timemodified + (orderkey % 12) * 86400").alias("timemodified"),
    )
    tables = {
        "course": course,
        "context": course.select(
            _e("1000 + id").alias("id"), F.lit(50).alias("contextlevel"), F.col("id").alias("instanceid")
        ),
        "role": literal_rows(
            spark, [(3, "editingteacher"), (4, "teacher"), (5, "student")], "id long, shortname string"
        ),
        "role_assignments": role_assignments,
        "logstore_standard_log": _log(raw("events")),
        "assign": course.select(
            _e("explode(transform(array(0, 1, 2, 3), a -> id * 10 + a))").alias("id"), F.col("id").alias("course")
        ),
        "assign_submission": submissions,
        "assign_grades": grades,
        "assignfeedback_comments": _comments(raw("orders"), raw("documents")),
        "forum_discussions": discussions,
        "forum_posts": _posts(raw("conversations"), role_assignments),
    }
    return LearningTables.from_reader(lambda name: conform(tables[name], name))


def _role_assignments(events: DataFrame) -> DataFrame:
    """Three courses per user; some users get a second role or a second enrolment in their first course."""
    role = "if(u % 10 = 0, 3L, if(u % 5 = 0, 4L, 5L))"
    rows = ", ".join(
        [f"struct(u * 10 + {j} as id, u as userid, 1001 + (u + {7 * j}) % {COURSES} as contextid, {role} as roleid, "
         f"true as kept)" for j in range(3)]
        + [f"struct(u * 10 + 3 as id, u as userid, 1001 + u % {COURSES} as contextid, 4L as roleid, "
           f"u % 20 = 1 as kept)",
           f"struct(u * 10 + 4 as id, u as userid, 1001 + u % {COURSES} as contextid, 5L as roleid, "
           f"u % 10 = 2 as kept)"]
    )
    return (
        events.select(F.col("user_id").alias("u")).distinct().select(_e(f"inline(array({rows}))"))
        .filter("kept").drop("kept")
    )


def _log(events: DataFrame) -> DataFrame:
    k = _e("cast(get_json_object(props, '$.k') as int)")
    module = _e("element_at(array('mod_forum', 'mod_assign', 'mod_resource', 'mod_url', 'mod_page', 'mod_lesson'), k % 6 + 1)")
    kind = F.when(F.col("event_type") == "click", F.when(F.col("k") % 2 == 0, "visit").otherwise("discussion")).otherwise(
        F.col("event_type")
    )

    def by_kind(signup: str, visit: str, discussion: str, view: Column, purchase: str, error: str) -> Column:
        chosen = F.lit(error)
        for name, value in (
            ("purchase", F.lit(purchase)), ("view", view), ("discussion", F.lit(discussion)),
            ("visit", F.lit(visit)), ("signup", F.lit(signup)),
        ):
            chosen = F.when(F.col("kind") == name, value).otherwise(chosen)
        return chosen

    place = f"(user_id + 7 * (event_id % 3)) % {COURSES} + 1"
    return (
        events.withColumn("k", k)
        .withColumns({"module": module, "kind": kind})
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("userid"),
            _e(f"if(event_type = 'signup', 0L, {place})").alias("courseid"),
            by_kind(
                r"\core\event\user_loggedin", r"\core\event\course_viewed", r"\mod_forum\event\discussion_viewed",
                F.concat(F.lit("\\"), F.col("module"), F.lit(r"\event\course_module_viewed")),
                r"\mod_assign\event\assessable_submitted", r"\core\event\user_profile_viewed",
            ).alias("eventname"),
            by_kind("core", "core", "mod_forum", F.col("module"), "mod_assign", "core").alias("component"),
            by_kind("loggedin", "viewed", "viewed", F.lit("viewed"), "submitted", "viewed").alias("action"),
            _e("cast(k % 10 as bigint)").alias("objectid"),
            _e(f"({place}) * 10 + k % 4").alias("contextinstanceid"),
            # independent of the session time zone
            _e(_LOG_TIME).alias("timecreated"),
        )
    )


def _submissions(orders: DataFrame) -> DataFrame:
    """One submission per order; attempts numbered per (user, assignment), the last one being the latest."""
    placed = orders.select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_totalprice").alias("totalprice"),
        _e("o_orderkey + 1").alias("id"),
        _e("o_custkey div 10").alias("userid"),
        _e(f"((o_custkey div 10 + 7 * (o_orderkey % 3)) % {COURSES} + 1) * 10 + (o_orderkey div 3) % 4").alias("assignment"),
        _e(f"cast({T0} + (datediff(o_orderdate, date'1995-01-01') % 30) * 86400 + o_orderkey % 86400 as bigint)").alias("timecreated"),
        _e("if(o_orderstatus = 'P', 'draft', 'submitted')").alias("status"),
    )
    numbered = number_within(placed, ("userid", "assignment"), "orderkey", "attempt", total="attempts")
    return numbered.select(
        "*",
        _e("timecreated + 3600 * (orderkey % 5)").alias("timemodified"),
        _e("attempt - 1").alias("attemptnumber"),
        _e("if(attempt = attempts, 1, 0)").alias("latest"),
    )


def _comments(orders: DataFrame, documents: DataFrame) -> DataFrame:
    """Comments on graded orders, each a whole document and a closing phrase.

    Most graded orders share their document with the 14 orders next to it. Besides, every document is a comment of its own, on
    the grade of order 7 * doc_id + 1, so that all documents are used at every size.
    """
    written = orders.filter("o_orderkey % 7 <> 0").select(
        "o_orderkey",
        _e(f"((o_custkey div 10 + 7 * (o_orderkey % 3)) % {COURSES} + 1) * 10 + (o_orderkey div 3) % 4").alias("assignment"),
        _e("inline(array(struct(0L as n, o_orderkey div 15 as doc_id, o_orderkey % 5 <> 0 as kept), "
           "struct(1L as n, o_orderkey div 7 as doc_id, o_orderkey % 7 = 1 as kept)))"),
    ).filter("kept")
    closing = "element_at(array(' Please REVIEW the rubric', ' keep it up', ' Focus on detail', ''), cast(o_orderkey % 4 as int) + 1)"
    return written.join(documents.select("doc_id", "text"), "doc_id").select(
        _e("2 * (o_orderkey + 1) + n").alias("id"),
        "assignment",
        _e("o_orderkey + 1").alias("grade"),
        _e(f"concat(text, {closing})").alias("commenttext"),
    )


def _posts(conversations: DataFrame, role_assignments: DataFrame) -> DataFrame:
    """Turns become posts of a course member: user turns of a student, assistant turns of a teacher.

    A turn without such a member (system turns among them) is the post of a stranger with a negative id, in no roster.
    """
    members = role_assignments.select(
        _e("contextid - 1000").alias("course"), _e("if(roleid = 5, 'user', 'assistant')").alias("role"), "userid"
    ).distinct()
    numbered = number_within(members, ("course", "role"), "userid", "member_no")
    sizes = members.groupBy("course", "role").agg(F.count(F.lit(1)).alias("members"))
    closing = (
        "case when role = 'user' and turn >= 2 and conv_id % 3 = 0 then ' Thanks, that WORKED' "
        "when role = 'user' and turn >= 2 and conv_id % 3 = 1 then ' still stuck' else '' end"
    )
    return (
        conversations.withColumn("course", _e(f"conv_id % {COURSES} + 1"))
        .join(sizes, ["course", "role"], "left")
        .withColumn("member_no", _e(f"(conv_id div {COURSES}) % members + 1"))
        .join(numbered, ["course", "role", "member_no"], "left")
        .select(
            _e("conv_id * 10 + turn + 1").alias("id"),
            _e("conv_id + 1").alias("discussion"),
            _e("if(turn = 0, 0L, conv_id * 10 + turn)").alias("parent"),
            _e("coalesce(userid, -1 - conv_id)").alias("userid"),
            _e(f"{T0} + (conv_id * 18000) % (28 * 86400) + turn * 600").alias("created"),
            _e(f"concat(text, {closing})").alias("message"),
        )
    )
