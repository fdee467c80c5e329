"""Hand-made cases for the student indicators."""

from learnlens.operators.logins import login_course_access
from learnlens.plans import student
from tests.conftest import STUDENT, event, rows

AS_OF = 1_000_000
OPEN = [(1, 0, 0)]
LONG = [(1, 0, 2_000_000)]
ONE = [(7, 1, STUDENT)]


def totals(df, column):
    return {(r.student_id, r.course_id): r[column] for r in df.collect()}


def active(t, **options):
    return totals(student.student_active_time(t, AS_OF, **options), "active_time_seconds")


def forum(t, **options):
    return totals(student.time_spent_forums(t, AS_OF, **options), "total_seconds_spent")


def objects(t, **options):
    return totals(student.time_spent_lo(t, AS_OF, **options), "learning_object_view_time_seconds")


def assignments(t, **options):
    return totals(student.time_spent_assignments(t, AS_OF, **options), "assignment_time_seconds")


def frequency(t):
    return {r.student_id: r.login_frequency for r in student.login_frequency(t, AS_OF).collect()}


def test_open_ended_course(world):
    log = [event(1, 7, 0, AS_OF - 100, "login"), event(2, 7, 1, AS_OF - 90), event(3, 7, 1, AS_OF - 50)]
    t = world(OPEN, ONE, logstore_standard_log=log)
    assert active(t) == {(7, 1): 0}
    assert frequency(t) == {7: 1}
    assert active(t, open_end_at=AS_OF) == {(7, 1): 40}


def test_lone_event_adds_nothing(world):
    t = world(LONG, ONE, logstore_standard_log=[event(1, 7, 1, AS_OF - 5, "forum")])
    assert active(t) == {(7, 1): 0}
    assert forum(t) == {(7, 1): 0}
    assert objects(world(LONG, ONE, logstore_standard_log=[event(1, 7, 1, AS_OF - 5, "page")])) == {(7, 1): 0}


def test_no_forum_view_means_no_row(world):
    t = world(LONG, ONE, logstore_standard_log=[event(1, 7, 1, AS_OF - 5, "page")])
    assert forum(t) == {}


def test_forum_view_hidden_by_tied_event_still_gives_a_row(world):
    log = [event(1, 7, 1, AS_OF - 50, "forum"), event(2, 7, 1, AS_OF - 50, "page"), event(3, 7, 1, AS_OF - 20)]
    t = world(LONG, ONE, logstore_standard_log=log)
    assert forum(t) == {(7, 1): 0}
    assert objects(t) == {(7, 1): 30}


def test_gap_at_cap(world):
    times = [AS_OF - 9000]
    for gap in (1799, 1800, 1801):
        times.append(times[-1] + gap)
    log = [event(i, 7, 1, time, "page") for i, time in enumerate(times)]
    t = world(LONG, ONE, logstore_standard_log=log)
    assert active(t) == {(7, 1): 1799 + 1800 + 1800}
    assert objects(t) == {(7, 1): 1799 + 1800 + 1800}


def test_clip_comes_before_the_gap(world):
    log = [event(1, 7, 1, AS_OF - 10), event(2, 7, 1, AS_OF + 10)]
    assert active(world(LONG, ONE, logstore_standard_log=log)) == {(7, 1): 0}


def test_window_ends_are_inclusive(world):
    log = [event(1, 7, 1, AS_OF - 604800 - 1), event(2, 7, 1, AS_OF - 604800), event(3, 7, 1, AS_OF)]
    t = world([(1, AS_OF - 604800, AS_OF)], ONE, logstore_standard_log=log)
    assert active(t, sessioncap=86400) == {(7, 1): 86400}


def test_gap_across_midnight(world):
    log = [event(1, 7, 1, 86400 * 11 - 10), event(2, 7, 1, 86400 * 11 + 20)]
    assert active(world(LONG, ONE, logstore_standard_log=log)) == {(7, 1): 30}


def test_inactive_event_ends_a_gap(world):
    base = AS_OF - 1000
    log = [event(1, 7, 1, base, "page"), event(2, 7, 1, base + 100, "profile"), event(3, 7, 1, base + 400, "page")]
    assert active(world(LONG, ONE, logstore_standard_log=log)) == {(7, 1): 100}


def test_like_wildcard(world):
    base = AS_OF - 1000
    log = [
        event(1, 7, 1, base, "profile", component="modXa"),
        event(2, 7, 1, base + 60, "profile", component="mod"),
        event(3, 7, 1, base + 120, "profile"),
    ]
    assert active(world(LONG, ONE, logstore_standard_log=log)) == {(7, 1): 60}


def test_event_name_with_backslashes_counts_as_active(world):
    log = [event(1, 7, 1, AS_OF - 50, "course"), event(2, 7, 1, AS_OF - 20, "profile")]
    assert active(world(LONG, ONE, logstore_standard_log=log)) == {(7, 1): 30}


def test_users_outside_the_roster_are_left_out(world):
    log = [event(1, 8, 1, AS_OF - 50, "forum"), event(2, 8, 1, AS_OF - 20, "page")]
    t = world(LONG, ONE, logstore_standard_log=log)
    assert active(t) == {(7, 1): 0}
    assert forum(t) == {}


def test_one_login_two_courses(world):
    log = [event(1, 7, 0, 100, "login"), event(2, 7, 1, 110), event(3, 7, 2, 120)]
    t = world([(1, 0, 900), (2, 0, 900)], [(7, 1, STUDENT), (7, 2, STUDENT)], logstore_standard_log=log)
    assert frequency(t) == {7: 1}
    assert rows(login_course_access(t, AS_OF), "login_id", "course_id") == [(1, 1), (1, 2)]
    assert active(t) == {(7, 1): 0, (7, 2): 0}


def test_tied_logins(world):
    log = [event(1, 7, 0, 100, "login"), event(2, 7, 0, 100, "login"), event(3, 7, 1, 100)]
    t = world(LONG, ONE, logstore_standard_log=log)
    assert frequency(t) == {7: 1}
    assert rows(login_course_access(t, AS_OF), "login_id") == [(2,)]


def test_login_carried_over_days_and_course_window(world):
    log = [event(1, 7, 0, 100, "login"), event(2, 7, 1, 86400 * 5), event(3, 7, 0, 86400 * 6, "login"),
           event(4, 7, 1, 86400 * 9)]
    # The second login is after the course end; the first one's view may be later than that end.
    t = world([(1, 0, 1000)], ONE, logstore_standard_log=log)
    assert rows(login_course_access(t, AS_OF), "login_id", "login_time") == [(1, 100)]


def test_login_without_view_counts_zero(world):
    t = world(LONG, ONE, logstore_standard_log=[event(1, 7, 1, 50), event(2, 7, 0, 100, "login")])
    assert frequency(t) == {7: 0}


def test_submit_before_first_view(world):
    log = [event(1, 7, 1, AS_OF - 50, "submit"), event(2, 7, 1, AS_OF - 20, "assign")]
    assert assignments(world(LONG, ONE, logstore_standard_log=log)) == {(7, 1): 0}


def test_first_view_to_first_submit_per_module(world):
    log = [
        event(1, 7, 1, AS_OF - 5000, "assign"), event(2, 7, 1, AS_OF - 4000, "assign"),
        event(3, 7, 1, AS_OF - 1000, "submit"), event(4, 7, 1, AS_OF - 900, "submit"),
        event(5, 7, 1, AS_OF - 300, "assign", module=11), event(6, 7, 1, AS_OF - 100, "submit", module=11),
        event(7, 7, 1, AS_OF - 90, "assign", module=12),
    ]
    assert assignments(world(LONG, ONE, logstore_standard_log=log)) == {(7, 1): 4000 + 200}


def test_submission_row_without_event_counts_nothing(world):
    t = world(
        LONG, ONE, logstore_standard_log=[event(1, 7, 1, AS_OF - 50, "assign")],
        assign=[(10, 1)], assign_submission=[(1, 10, 7, AS_OF - 20, AS_OF - 20, "submitted", 0, 1)],
    )
    assert assignments(t) == {(7, 1): 0}


def test_counts_are_for_all_time_and_distinct(world):
    log = [
        event(1, 7, 1, 5, "forum"), event(2, 7, 1, 3_000_000, "assign"), event(3, 7, 1, 9, "discussion", object=4),
        event(4, 7, 1, 10, "discussion", object=4), event(5, 7, 1, 11, "discussion", object=5), event(6, 7, 1, 12),
    ]
    t = world(
        LONG, [*ONE, (8, 1, STUDENT)], logstore_standard_log=log,
        forum_discussions=[(1, 1), (2, 99)],
        forum_posts=[(1, 1, 0, 7, 5, "a"), (2, 1, 1, 7, 6, "b"), (3, 2, 0, 7, 6, "c")],
    )
    assert totals(student.lo_access_frequency(t), "learning_object_access_frequency") == {(7, 1): 2, (8, 1): 0}
    assert totals(student.number_forums_viewed(t), "forums_viewed_count") == {(7, 1): 2, (8, 1): 0}
    assert totals(student.forum_posting_frequency(t), "forum_post_frequency") == {(7, 1): 2, (8, 1): 0}


def test_duplicate_enrolment_is_one_row(world):
    t = world(LONG, [*ONE, *ONE])
    assert totals(student.lo_access_frequency(t), "learning_object_access_frequency") == {(7, 1): 0}


def test_record_ids_and_sort_orders(world):
    t = world([(1, 0, 9), (2, 0, 9)], [(u, c, STUDENT) for u in (3, 4) for c in (2, 1)])
    by_student = [tuple(r)[:3] for r in student.lo_access_frequency(t).collect()]
    assert by_student == [(1, 3, 1), (3, 3, 2), (2, 4, 1), (4, 4, 2)]
    by_course = [tuple(r)[:3] for r in student.number_forums_viewed(t).collect()]
    assert by_course == [(1, 3, 1), (2, 4, 1), (3, 3, 2), (4, 4, 2)]


def test_chosen_courses_only(world):
    t = world([(1, 0, 9), (2, 0, 9)], [(3, 1, STUDENT), (3, 2, STUDENT)],
              logstore_standard_log=[event(1, 3, 1, 5, "page"), event(2, 3, 2, 5, "page")])
    assert totals(student.lo_access_frequency(t, [2]), "learning_object_access_frequency") == {(3, 2): 1}
