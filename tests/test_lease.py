"""One holder at a time, takeover of a stale lease, and no way back for its holder."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from lodestrata.streaming.lease import Held, Lease


def test_one_of_many_gets_the_lease(spark, tmp_path):
    def take(_):
        try:
            Lease(spark, f"file://{tmp_path}/lease").acquire()
            return 1
        except Held:
            return 0

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(take, range(6))) == 1


def test_release_renewal_and_takeover(spark, tmp_path):
    clock = [0.0]
    one, two = (Lease(spark, f"file://{tmp_path}/lease", ttl_s=10, now=lambda: clock[0]) for _ in range(2))
    with one:
        with pytest.raises(Held):
            two.acquire()
        clock[0] = 8
        one.renew()
        clock[0] = 15
        with pytest.raises(Held):
            two.acquire()
    two.acquire()
    clock[0] = 40  # it has run out
    one.acquire()
    with pytest.raises(Held):
        two.renew()
    two.release()  # not its own any more
    one.renew()
    for _ in range(5):
        one.renew()
    assert len(list((tmp_path / "lease").glob("0*.json"))) <= 3
