"""Page tasks: resumed, stopped, replayed and forgotten."""

import pytest
from pyspark.sql import Row

from scriptorium.operators import tasks
from scriptorium.streaming.page_tasks import PageTasks, _Steps, status_of


@pytest.fixture
def store(spark, tmp_path):
    return PageTasks(spark, str(tmp_path / "store"))


def rows(spark, *found):
    return spark.createDataFrame(found, "task_id long, total long, only array<long>, skip array<long>")


def state(store):
    return {r.task_id: (r.total, r.completed, r.failed, r.status) for r in store.progress().collect()}


def tried(store):
    return sorted((r.task_id, r.page, r.status) for r in store.attempts().collect())


def processed(broken):
    """Pages of ``broken`` (task, page) fail."""

    def work(task, page):
        if (task, page) in broken:
            raise ValueError(f"no page {page}")
        return f"t{task}p{page}"

    return lambda pages: tasks.process_pages(pages, work)


def test_each_page_once_failed_ones_again(spark, store):
    store.start(rows(spark, (1, 5, None, None), (2, 4, [4, 2, 2, 9, 0], [4]), (3, 0, None, None), (4, 1, None, None)))
    store.run_until_idle(processed({(1, 3), (4, 1)}), portion=2)
    assert tried(store) == [(1, 1, "success"), (1, 2, "success"), (1, 3, "failed"), (1, 4, "success"), (1, 5, "success"), (2, 2, "success"), (4, 1, "failed")]
    assert state(store) == {1: (5, 4, 1, "completed"), 2: (4, 1, 0, "processing"), 3: (0, 0, 0, "pending"), 4: (1, 0, 1, "failed")}
    # The same by the roll-up over the log.
    own = spark.createDataFrame([(1, 5), (2, 4), (3, 0), (4, 1)], "task_id long, total long")
    assert {r.task_id: (r.total, r.completed, r.failed, r.status) for r in tasks.progress(own, store.attempts()).collect()} == state(store)
    # A second start: what is completed stays, what succeeded isn't done again, totals don't change.
    store.start(rows(spark, (1, 5, None, None), (2, 99, None, None), (4, 1, None, None)))
    store.run_until_idle(processed(set()))
    assert tried(store)[5:] == [(2, 1, "success"), (2, 2, "success"), (2, 3, "success"), (2, 4, "success"), (4, 1, "failed"), (4, 1, "success")]
    assert state(store) == {1: (5, 4, 1, "completed"), 2: (4, 4, 0, "completed"), 3: (0, 0, 0, "pending"), 4: (1, 1, 1, "completed")}
    assert {r.task_id: r.text for r in store.full_text().collect()} == {1: "t1p1\n\nt1p2\n\nt1p4\n\nt1p5", 2: "t2p1\n\nt2p2\n\nt2p3\n\nt2p4", 4: "t4p1"}
    assert {(r.task_id, r.page): r.status for r in store.results().collect()}[(4, 1)] == "success"


def test_failure_after_writing_is_replayed_without_doubles(spark, store):
    store.start(rows(spark, (1, 5, None, None), (2, 3, None, None)))
    seen = []

    def broken(attempts, number):
        seen.append((number, attempts.count()))
        if len(seen) == 2:
            raise RuntimeError("lost after the portion was written")

    with pytest.raises(Exception, match="lost after the portion"):
        store.run_until_idle(processed({(1, 4)}), portion=2, on_batch=broken)
    store = PageTasks(spark, store.folder)  # as a driver that starts anew
    store.run_until_idle(processed({(1, 4)}), portion=2, on_batch=broken)
    assert tried(store) == [*((1, p, "failed" if p == 4 else "success") for p in range(1, 6)), *((2, p, "success") for p in range(1, 4))]
    assert [n for _, n in seen] == [4, 3, 3, 1] and seen[1][0] == seen[2][0]
    assert state(store) == {1: (5, 4, 1, "completed"), 2: (3, 3, 0, "completed")}


def test_cancel_stops_before_the_next_portion_and_a_start_goes_on(spark, store):
    store.start(rows(spark, (1, 10, None, None), (2, 2, None, None)))
    one = rows(spark, (1, None, None, None), (2, None, None, None))
    cancelled = []

    def cancel(attempts, number):
        if not cancelled:
            cancelled.append(number)
            store.cancel(one)

    store.run_until_idle(processed(set()), portion=3, on_batch=cancel)
    assert state(store) == {1: (10, 3, 0, "cancelled"), 2: (2, 2, 0, "completed")}
    store.start(rows(spark, (1, 10, None, [10])))
    store.run_until_idle(processed(set()), portion=4)
    assert state(store)[1] == (10, 9, 0, "processing") and len(tried(store)) == 11


def test_deleted_tasks_begin_anew(spark, store):
    store.start(rows(spark, (1, 2, None, None), (2, 1, None, None)))
    store.run_until_idle(processed(set()))
    store.delete(rows(spark, (1, None, None, None), (7, None, None, None)))
    store.run_until_idle(processed(set()))
    assert state(store) == {2: (1, 1, 0, "completed")} and tried(store) == [(2, 1, "success")]
    store.start(rows(spark, (1, 3, None, None)))
    store.run_until_idle(processed({(1, 1)}))
    assert state(store)[1] == (3, 2, 1, "completed") and len(tried(store)) == 4
    store.delete_old(days=0)
    store.run_until_idle(processed(set()))
    assert state(store) == {} and tried(store) == []


def test_status_rule():
    assert [status_of(*x) for x in ((0, 0, 0, False), (3, 0, 0, False), (3, 1, 1, False), (3, 2, 1, False), (3, 0, 3, False), (3, 3, 0, True))] == ["pending", "pending", "processing", "completed", "failed", "cancelled"]


class _Value:
    """Stands for a value or a map of the state, and counts the calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("update", "updateValue"):
                self.held[args[:-1]] = args[-1]
            elif name == "clear":
                self.held.clear()
            elif name == "exists":
                return bool(self.held)
            else:
                return self.held.get(args)

        return call


def test_calls_to_the_state_do_not_grow_with_pages():
    steps = _Steps(2000, 7)
    steps.task, steps.pages = _Value(), _Value()
    start = {"kind": "start", "total": 1500, "only": None, "skip": None, "page": None, "status": None, "at": 0}
    out = list(steps.handleInputRows((1,), iter([Row(**start)]), None))
    assert [r.page for r in out[1:]] == list(range(1, 1501))
    tried = [Row(**start | {"kind": "attempt", "page": r.page, "status": "failed" if r.page % 3 == 0 else "success"}) for r in out[1:]]
    assert [tuple(r)[3:7] for r in steps.handleInputRows((1,), iter(tried), None)] == [(1500, 1000, 500, "completed")]
    assert steps.task.calls + steps.pages.calls <= 12


def test_pages_of_several_blocks_are_tried_again_and_counted_once():
    steps = _Steps(5000, 7)
    steps.task, steps.pages = _Value(), _Value()
    start = {"kind": "start", "total": 2500, "only": None, "skip": [2], "page": None, "status": None, "at": 0}
    attempt = lambda page, status: Row(**start | {"kind": "attempt", "page": page, "status": status})
    list(steps.handleInputRows((1,), iter([Row(**start)]), None))
    list(steps.handleInputRows((1,), iter([attempt(p, "failed" if p in (999, 1000, 2500) else "success") for p in range(1, 2501) if p != 2]), None))
    out = list(steps.handleInputRows((1,), iter([Row(**start | {"skip": None})]), None))
    assert [(r.page, r.attempt) for r in out[1:]] == [(2, 1), (999, 2), (1000, 2), (2500, 2)]
