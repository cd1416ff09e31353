"""Calls that share a thread, and retries that fall due between items."""

import threading
import time

from tilewright.operators import tasks


def test_one_thread_serves_all_calls_until_one_hangs():
    names = []

    def call(item):
        names.append(threading.current_thread().name)
        if item["k"] == 3:
            time.sleep(1.0)
        return 200, "ok"

    got = [row[3] for row in tasks.outcomes(({"wsi_path": str(k), "k": k} for k in range(8)), call, 2, lambda seconds: None, 0.3)]
    assert got == ["done"] * 3 + ["timeout"] + ["done"] * 4
    assert len(set(names[:4])) == 1 and len(set(names[4:])) == 1 and names[3] != names[4]


def test_items_keep_their_order_when_retries_fall_due():
    now = iter(range(0, 10**9, 3))
    seen = {}

    def call(item):
        seen[item["k"]] = seen.get(item["k"], 0) + 1
        return (500, "Internal Server Error") if seen[item["k"]] == 1 else (200, "ok")

    got = list(tasks.outcomes(({"wsi_path": str(k), "k": k} for k in range(5000)), call, 2, lambda seconds: None, 5.0, lambda: next(now)))
    assert sorted(int(p) for p, *_ in got) == list(range(5000)) and {row[1:4] for row in got} == {(200, 2, "done")}
