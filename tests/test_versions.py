"""Versioned index tables: only what changed is read again, readers keep their version, commits never overwrite."""

import os
import random

import pytest

from twinsieve.operators.filters import prepare_side
from twinsieve.plans.index import build_or_load, exact_facts
from twinsieve.plans.versions import CommitConflict, Folder, compact, open_version, refresh, vacuum, versions
from twinsieve.sources.filetree import scan_tree

SCHEMA = "path string, size long, mtime timestamp, name string, ext string, content string"


def files(spark, state):
    from datetime import datetime

    rows = [(p, len(c), datetime(2024, 1, 1, 0, 0, t), p, ".jpg", c) for p, (c, t) in state.items()]
    return spark.createDataFrame(rows, SCHEMA)


def facts_of(version):
    return {r.path: r.content_hash for r in version.rows().collect()}


def expected(state):
    import hashlib

    return {p: hashlib.sha256(c.encode()).hexdigest() for p, (c, _) in state.items()}


def test_random_histories_equal_a_rebuild(spark, tmpdir_path):
    rnd, state, opened = random.Random(2), {f"p{i}": (f"text {i % 7}", i % 50) for i in range(25)}, []
    for step in range(7):
        got = refresh(spark, files(spark, state), f"{tmpdir_path}/t", exact_facts("sha256"), ref_path="r", options="o", max_generations=4, verify=True)
        assert facts_of(got.version) == expected(state), step
        opened.append((got.version, dict(state)))
        for p in rnd.sample(sorted(state), 3):
            del state[p]
        for p in rnd.sample(sorted(state), 4):
            state[p] = (state[p][0] + "!", state[p][1])
        state[f"new{step}"] = ("brand new", 1)
        state.setdefault("p3", ("back again", 3))
    for version, then in opened:  # readers of older versions see what they saw
        assert facts_of(version) == expected(then)
    assert len(opened[-1][0].generations) <= 4
    assert facts_of(compact(opened[-1][0])) == expected(opened[-1][1])
    gone = vacuum(spark, f"{tmpdir_path}/t", keep=1)
    assert gone and facts_of(open_version(spark, f"{tmpdir_path}/t")) == expected(opened[-1][1])
    assert len([n for n in os.listdir(f"{tmpdir_path}/t") if n.startswith("generation-")]) == 1


def _w(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_touching_one_file_reads_one_file(spark, tmpdir_path):
    root = f"{tmpdir_path}/ref"
    for i in range(12):
        _w(f"{root}/d{i % 3}/f{i}.bin", b"content %d" % i)
    listing = lambda: prepare_side(scan_tree(spark, root))
    first = build_or_load(spark, listing(), f"{tmpdir_path}/idx", ref_path=root)
    assert first.changes["exact"] == (12, 0)
    before = sorted(first.exact.collect())
    _w(f"{root}/d1/f4.bin", b"another content")
    os.remove(f"{root}/d0/f0.bin")
    second = build_or_load(spark, listing(), f"{tmpdir_path}/idx", ref_path=root)
    assert second.changes["exact"] == (1, 1) and not second.reused["exact"]
    assert sorted(first.exact.collect()) == before  # the old version still reads
    whole = build_or_load(spark, listing(), f"{tmpdir_path}/other", ref_path=root)
    assert sorted(second.exact.collect()) == sorted(whole.exact.collect())
    third = build_or_load(spark, listing(), f"{tmpdir_path}/idx", ref_path=root)
    assert third.reused["exact"] and sorted(third.exact.collect()) == sorted(second.exact.collect())


def test_same_totals_are_told_apart_by_verify(spark, tmpdir_path):
    state = {"a": ("one", 1), "b": ("two", 2), "c": ("six", 9)}
    refresh(spark, files(spark, state), f"{tmpdir_path}/t", exact_facts("sha256"))
    state["a"] = ("ONE", 0)  # the same count, bytes and newest time
    assert refresh(spark, files(spark, state), f"{tmpdir_path}/t", exact_facts("sha256")).reused
    got = refresh(spark, files(spark, state), f"{tmpdir_path}/t", exact_facts("sha256"), verify=True)
    assert (got.changed, got.gone) == (1, 0) and facts_of(got.version) == expected(state)


def test_failed_reads_are_tried_again(spark, tmpdir_path):
    root = f"{tmpdir_path}/ref"
    _w(f"{root}/a.bin", b"a")
    _w(f"{root}/b.bin", b"b")
    listed = prepare_side(scan_tree(spark, root))
    os.rename(f"{root}/b.bin", f"{root}/elsewhere")
    first = build_or_load(spark, listed, f"{tmpdir_path}/idx", ref_path=root)
    assert [os.path.basename(r.path) for r in first.exact.collect()] == ["a.bin"]
    os.rename(f"{root}/elsewhere", f"{root}/b.bin")
    second = build_or_load(spark, listed, f"{tmpdir_path}/idx", ref_path=root, verify=True)
    assert second.changes["exact"] == (1, 0) and second.exact.count() == 2


def test_commits_never_overwrite(spark, tmpdir_path):
    folder = Folder(spark, f"{tmpdir_path}/t")
    folder.commit("manifest/v0000000001.json", "{}")
    with pytest.raises(CommitConflict):
        folder.commit("manifest/v0000000001.json", '{"x": 1}')
    assert folder.read("manifest/v0000000001.json") == "{}" and folder.names("manifest") == ["v0000000001.json"]
    assert open_version(spark, f"{tmpdir_path}/t") is None  # unreadable reads as none: the next refresh starts anew
    got = refresh(spark, files(spark, {"a": ("x", 1)}), f"{tmpdir_path}/t", exact_facts("sha256"))
    assert got.version.number == 2 and versions(folder) == [1, 2]


def test_a_writer_that_died_leaves_the_old_version(spark, tmpdir_path):
    state = {"a": ("one", 1), "b": ("two", 2)}
    refresh(spark, files(spark, state), f"{tmpdir_path}/t", exact_facts("sha256"))

    def dies(f, todo):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        refresh(spark, files(spark, state | {"c": ("three", 3)}), f"{tmpdir_path}/t", dies)
    assert facts_of(open_version(spark, f"{tmpdir_path}/t")) == expected(state)
    state["c"] = ("three", 3)
    got = refresh(spark, files(spark, state), f"{tmpdir_path}/t", exact_facts("sha256"))
    assert facts_of(got.version) == expected(state) and got.changed == 1


def test_empty_trees_and_other_options(spark, tmpdir_path):
    none = files(spark, {"a": ("x", 1)}).limit(0)
    got = refresh(spark, none, f"{tmpdir_path}/t", exact_facts("sha256"))
    assert got.version.rows().count() == 0 and refresh(spark, none, f"{tmpdir_path}/t", exact_facts("sha256")).reused
    full = refresh(spark, files(spark, {"a": ("x", 1)}), f"{tmpdir_path}/t", exact_facts("sha256"))
    assert full.changed == 1
    other = refresh(spark, files(spark, {"a": ("x", 1)}), f"{tmpdir_path}/t", exact_facts("blake2b"), options="blake2b")
    assert other.changed == 1 and len(other.version.generations) == 1 and len(next(iter(facts_of(other.version).values()))) == 128
