"""The stream of a tree's files: every state once, after restarts too, and equal to the batch result."""

import os
import time

import pytest

from twinsieve.operators.classify import classify
from twinsieve.operators.filters import prepare_side
from twinsieve.plans.index import build_or_load
from twinsieve.plans.versions import versions, Folder
from twinsieve.sources.filestream import TreeStreamReader, discover, read_file_stream
from twinsieve.sources.filetree import scan_tree
from twinsieve.streaming.classify_stream import read_stream_results, start_tree_stream


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture()
def sides(spark, tmpdir_path):
    ref, tgt = f"{tmpdir_path}/ref", f"{tmpdir_path}/target"
    for i in range(6):
        _w(f"{ref}/r{i}.txt", f"known {i}")
    index = build_or_load(spark, prepare_side(scan_tree(spark, ref)), f"{tmpdir_path}/idx", ref_path=ref)
    return index, tgt, tmpdir_path


def _drop(tgt, k):
    for i in range(4):
        _w(f"{tgt}/drop{k}/sub{i % 2}/f{i}.txt", f"known {i}" if i % 2 else f"new {k} {i}")
    _w(f"{tgt}/drop{k}/.DS_Store", "x")


def _once(spark, index, tgt, base, **kw):
    q = start_tree_stream(spark, tgt, f"{base}/log", index, f"{base}/results", f"{base}/ckpt", **kw)
    q.awaitTermination()
    return sorted(map(tuple, read_stream_results(spark, f"{base}/results").collect()))


def _batch(spark, index, tgt):
    return sorted(map(tuple, classify(None, prepare_side(scan_tree(spark, tgt)), exact_index=index.exact).collect()))


def test_three_drops_equal_the_batch_result(spark, sides):
    index, tgt, base = sides
    for k in range(3):
        _drop(tgt, k)
        got = _once(spark, index, tgt, base)  # a new query from the same checkpoint each time
        assert got == _batch(spark, index, tgt) and len(got) == 4 * (k + 1)
    assert _once(spark, index, tgt, base) == _batch(spark, index, tgt)  # nothing new: nothing added
    _w(f"{tgt}/drop0/sub0/f0.txt", "changed again")
    os.remove(f"{tgt}/drop1/sub1/f1.txt")
    again = _once(spark, index, tgt, base)
    assert len(again) == 13 and sum(r[0].endswith("drop0/sub0/f0.txt") for r in again) == 2  # one more state of one file


def test_drops_found_while_no_query_ran_come_in_one_batch(spark, sides):
    index, tgt, base = sides
    for k in range(3):
        _drop(tgt, k)
        assert discover(spark, tgt, f"{base}/log") == k + 1
    assert discover(spark, tgt, f"{base}/log") == 4  # looked, found nothing
    reader = TreeStreamReader({"log": f"{base}/log"})
    assert reader.initialOffset() == {"version": 0} and reader.latestOffset() == {"version": 4}
    assert reader.partitions({"version": 3}, {"version": 4}) == []
    rows = [r for p in reader.partitions({"version": 1}, {"version": 3}) for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 10 and {r["rel_path"].split("/")[0] for r in rows} == {"drop1", "drop2"}
    assert _once(spark, index, tgt, base) == _batch(spark, index, tgt)


def test_a_discovery_that_died_is_made_again(spark, sides):
    index, tgt, base = sides
    _drop(tgt, 0)
    folder = Folder(spark, f"{base}/log")
    os.makedirs(f"{base}/log/generation-0000000001-dead/files")  # written, never committed
    assert versions(folder) == []
    assert _once(spark, index, tgt, base) == _batch(spark, index, tgt)


def test_scratch_goes_with_the_batch(spark, sides):
    from twinsieve.session import checkpoint_dir

    index, tgt, base = sides
    root = checkpoint_dir(spark).removeprefix("file://")
    _drop(tgt, 0)
    _once(spark, index, tgt, base)
    before = set(os.listdir(root))
    _drop(tgt, 1)
    _once(spark, index, tgt, base)
    new = [n for n in set(os.listdir(root)) - before if "hashed" in n or "fingerprints" in n or "hot-groups" in n]
    assert new == []


def test_following_a_tree(spark, sides):
    index, tgt, base = sides
    _drop(tgt, 0)
    q = start_tree_stream(spark, tgt, f"{base}/log", index, f"{base}/results", f"{base}/ckpt", every=0.5, seconds=1)
    try:
        _drop(tgt, 1)
        end = time.time() + 120
        while time.time() < end:
            done = os.path.isdir(f"{base}/results") and any(n.startswith("batch_id=") and os.path.exists(f"{base}/results/{n}/_SUCCESS") for n in os.listdir(f"{base}/results"))
            if done and read_stream_results(spark, f"{base}/results").count() >= 8:
                break
            time.sleep(1)
    finally:
        q.follower.stop()
        q.stop()
    assert q.follower.failed is None and sorted(map(tuple, read_stream_results(spark, f"{base}/results").collect())) == _batch(spark, index, tgt)


def test_a_stream_needs_its_log(spark):
    with pytest.raises(Exception, match="log"):
        TreeStreamReader({})
    assert read_file_stream(spark, "/tmp/none").isStreaming
