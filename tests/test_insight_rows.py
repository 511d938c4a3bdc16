from types import SimpleNamespace

from tidemill.streaming import insights as I


def test_attempts_are_rows_and_a_spent_timer_without_one_gives_nothing():
    held, kept = {}, []
    job = I.Insights(lambda kind, *_: kind, 1000, 10_000)
    job.handle = SimpleNamespace(registerTimer=kept.append, deleteTimer=kept.remove)
    job.held = SimpleNamespace(get=lambda: held.get("v"), exists=lambda: "v" in held, update=lambda v: held.update(v=v), clear=held.clear)
    rows = [SimpleNamespace(ms=5, revision=2), SimpleNamespace(ms=1, revision=1)]
    assert [tuple(x) for x in job.handleInputRows((7,), iter(rows), None)] == [(7, r, k, 1, m, True, k) for r, m in ((1, 1), (2, 5)) for k in I.KINDS]
    assert kept == [10_005]
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 20_000)
    assert list(job.handleExpiredTimer((7,), late, SimpleNamespace(getExpiryTimeInMs=lambda: 10_005))) == [] and not held
