"""Real trees: listing rules, chunked hashing by path, images + pHash, and dedupe() end to end."""

import os
import re

import numpy as np
import pytest

from twinsieve.operators.filters import prepare_side
from twinsieve.plans.dedupe import dedupe, validate_paths
from twinsieve.sources.filetree import scan_binary, scan_tree
from twinsieve.sources.images import png_bytes


def _img(seed, size=64):
    rnd = np.random.default_rng(seed)
    base = rnd.random((8, 8)) * 255
    return np.kron(base, np.ones((size // 8, size // 8)))


def _w(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture()
def trees(tmpdir_path):
    ref = os.path.join(tmpdir_path, "ref")
    tgt = os.path.join(tmpdir_path, "target")
    _w(f"{ref}/a.JPG", b"alpha-bytes")
    _w(f"{ref}/sub/b.png", png_bytes(_img(1)))
    _w(f"{ref}/empty.txt", b"")
    _w(f"{ref}/.DS_Store", b"x")
    _w(f"{ref}/._a.JPG", b"x")
    _w(f"{ref}/.hidden.jpg", b"hidden")
    _w(f"{ref}/_under.jpg", b"under")
    _w(f"{ref}/_u/in.jpg", b"in")
    _w(f"{ref}/.Trash/q.jpg", b"q")
    _w(f"{ref}/a b#%é.jpg", b"odd name")
    os.symlink(f"{ref}/a.JPG", f"{ref}/link.jpg")
    os.symlink(f"{ref}/sub", f"{ref}/linkdir")
    _w(f"{tgt}/x/a_copy.jpg", b"alpha-bytes")                    # exact dup of a.JPG
    _w(f"{tgt}/x/b_big.png", png_bytes(np.kron(_img(1), np.ones((2, 2)))))  # resized b.png
    _w(f"{tgt}/x/other.png", png_bytes(_img(99)))                  # unrelated image
    _w(f"{tgt}/y/notes.txt", b"new text")                          # unique
    _w(f"{tgt}/y/zero.txt", b"")                                   # same (empty) content as ref
    _w(f"{tgt}/y/twin1.mov", b"same-new")                          # two identical new files:
    _w(f"{tgt}/y/twin2.mov", b"same-new")                          # both copied
    return ref, tgt, tmpdir_path


def test_listing_rules(spark, trees):
    ref, _, _ = trees
    got = {r.rel_path for r in prepare_side(scan_tree(spark, ref)).collect()}
    assert got == {"a.JPG", "sub/b.png", "empty.txt", ".hidden.jpg", "_under.jpg", "_u/in.jpg", "a b#%é.jpg"}
    # binaryFile differs exactly where documented: hidden/underscore names and empty files vanish
    bf = {r.rel_path for r in prepare_side(scan_binary(spark, ref)).collect()}
    assert "sub/b.png" in bf and ".hidden.jpg" not in bf and "empty.txt" not in bf


def test_dedupe_dry_run(spark, trees, tmpdir_path):
    ref, tgt, base = trees
    run = dedupe(spark, ref, tgt, f"{base}/out", index_dir=f"{base}/idx", dry_run=True)
    res = {os.path.relpath(r.target_path, tgt): (r.action, os.path.relpath(r.match_path, ref) if r.match_path else "") for r in run.results.collect()}
    assert res["x/a_copy.jpg"] == ("exact_dup", "a.JPG")
    assert res["y/zero.txt"] == ("exact_dup", "empty.txt")
    assert res["x/b_big.png"] == ("phash_dup", "sub/b.png")
    assert res["x/other.png"][0] == "copied"
    assert res["y/notes.txt"][0] == "copied"
    assert res["y/twin1.mov"][0] == res["y/twin2.mov"][0] == "copied"
    st = run.stats.first()
    assert (st.total_scanned, st.exact_duplicates, st.phash_duplicates, st.copied, st.skipped) == (7, 2, 1, 4, 0)
    assert not os.path.exists(f"{base}/out")
    again = dedupe(spark, ref, tgt, f"{base}/out", index_dir=f"{base}/idx", dry_run=True)
    assert again.index_reused == {"exact": True, "near": True}


def test_dedupe_copies_and_renames(spark, trees, tmpdir_path):
    ref, tgt, base = trees
    out = f"{base}/out"
    _w(f"{out}/y/notes.txt", b"something else")   # collision -> rename to notes_1.txt
    _w(f"{out}/y/twin1.mov", b"same-new")          # identical file already there
    run = dedupe(spark, ref, tgt, out, dry_run=False)
    res = {os.path.relpath(r.target_path, tgt): r for r in run.results.collect()}
    assert res["y/notes.txt"].reason == f"Copied to {out}/y/notes_1.txt"
    assert res["y/twin1.mov"].reason == f"Copied to {out}/y/twin1.mov"
    with open(f"{out}/y/notes_1.txt", "rb") as f:
        assert f.read() == b"new text"
    assert os.path.exists(f"{out}/x/other.png") and os.path.exists(f"{out}/y/twin2.mov")
    assert not os.path.exists(f"{out}/x/a_copy.jpg")
    leftovers = [n for _, _, names in os.walk(out) for n in names if ".part-" in n]
    assert leftovers == []  # copies land under their final names only


def test_validate_paths(trees):
    ref, tgt, base = trees
    with pytest.raises(ValueError):
        validate_paths(ref, tgt, ref)
    with pytest.raises(ValueError):
        validate_paths(ref, tgt, f"{tgt}/inside")
    with pytest.raises(ValueError):
        validate_paths(f"{base}/missing", tgt, f"{base}/o")
    validate_paths(ref, tgt, f"{base}/fine")


def test_empty_target(spark, trees, tmpdir_path):
    ref, _, base = trees
    os.makedirs(f"{base}/empty_target")
    run = dedupe(spark, ref, f"{base}/empty_target", f"{base}/o2")
    assert run.results.count() == 0 and run.stats.first().total_scanned == 0


def test_walk_splits_a_hot_deep_subtree(spark, tmpdir_path):
    # One deep subtree holds most files; the walk must list the rows that
    # os.lstat shows.
    root = os.path.join(tmpdir_path, "deep")
    expected = {}
    for i in range(40):
        rel = "hot/" + "/".join(f"l{j}" for j in range(i % 7)) + f"/f{i}.bin"
        _w(f"{root}/{rel}", b"x" * i)
        expected[rel.replace("//", "/")] = i
    _w(f"{root}/cold/one.txt", b"1")
    expected["cold/one.txt"] = 1
    os.mkdir(f"{root}/empty_dir")
    walk = {r.rel_path: (r.size, r.mtime) for r in scan_tree(spark, root, partitions=3).collect()}
    for rel, (size, mtime) in walk.items():
        s = os.lstat(f"{root}/{rel}")
        assert size == s.st_size and abs(mtime.timestamp() - s.st_mtime) < 1e-3
    assert {k: v[0] for k, v in walk.items()} == expected


def test_image_scan_reads_only_image_names(spark, tmpdir_path):
    from twinsieve.sources.images import image_extensions, read_images

    root = os.path.join(tmpdir_path, "imgs")
    _w(f"{root}/a.JPG", png_bytes(_img(3)))      # PNG bytes under a .JPG name still decode
    _w(f"{root}/s/b.png", png_bytes(_img(4)))
    _w(f"{root}/s/c.mov", b"not an image, never read")
    _w(f"{root}/d.Jpeg.txt", b"text")
    got = {os.path.relpath(r.path, root) for r in read_images(spark, root).collect()}
    assert got == {"a.JPG", "s/b.png"}
    only_png = {os.path.relpath(r.path, root) for r in read_images(spark, root, image_extensions(".png")).collect()}
    assert only_png == {"s/b.png"}


def test_phash_properties_corrupt_and_pixel_limit(spark, tmpdir_path):
    from twinsieve.sources.images import image_fingerprints

    root = os.path.join(tmpdir_path, "ph")
    _w(f"{root}/good.png", png_bytes(_img(5)))
    _w(f"{root}/copy.png", png_bytes(_img(5)))
    _w(f"{root}/resized.png", png_bytes(np.kron(_img(5), np.ones((2, 2)))))  # 128x128
    _w(f"{root}/other.png", png_bytes(_img(77)))
    _w(f"{root}/corrupt.png", b"\x89PNG\r\n\x1a\n not really a png")
    _w(f"{root}/warn.png", png_bytes(_img(6, size=40)))  # 1,600 px: between 1x and 2x of 1,000
    fps = {os.path.basename(r.path): r.fp for r in image_fingerprints(spark, root, max_image_pixels=1000).collect()}

    def dist(a, b):
        return ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count()

    # pixel limit: 64x64 = 4,096 px is above 2 x 1,000 -> no fingerprint; 1,600 px only warns
    assert fps["good.png"] is None and fps["resized.png"] is None and fps["warn.png"] is not None
    assert fps["corrupt.png"] is None  # kept as a row, no fingerprint
    fps = {os.path.basename(r.path): r.fp for r in image_fingerprints(spark, root).collect()}
    assert fps["corrupt.png"] is None and set(fps) == {"good.png", "copy.png", "resized.png", "other.png", "corrupt.png", "warn.png"}
    assert dist("good.png", "copy.png") == 0
    assert dist("good.png", "resized.png") <= 8
    assert dist("good.png", "other.png") > 8


def _run(spark, ref, tgt, out, **kw):
    run = dedupe(spark, ref, tgt, out, dry_run=False, **kw)
    return {os.path.relpath(r.target_path, tgt): r for r in run.results.collect()}, run


def _tree(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def test_second_run_finds_everything_present(spark, trees, tmpdir_path):
    ref, tgt, base = trees
    out = f"{base}/twice"
    _w(f"{tgt}/y/odd.bin", b"size that no ref file has")
    _run(spark, ref, tgt, out)
    before = _tree(out)
    res, run = _run(spark, ref, tgt, out)
    assert _tree(out) == before
    assert {r.op for r in run.plan.collect()} == {"already_present"}
    assert res["y/odd.bin"].reason == f"Copied to {out}/y/odd.bin"


def test_failed_copy_is_skipped(spark, trees, tmpdir_path):
    ref, tgt, base = trees
    out = f"{base}/blocked"
    _w(f"{out}/y", b"a file where a directory is needed")
    res, run = _run(spark, ref, tgt, out)
    row = res["y/notes.txt"]
    assert row.action == "skipped" and row.reason.startswith("Error: ") and row.match_type == ""
    assert run.stats.first().skipped == 3 and res["x/other.png"].action == "copied"


def test_unreadable_targets_are_never_copied(spark, trees, tmpdir_path):
    from twinsieve.operators.copyplan import selection

    rows = [("a", "a", 1, None, None, None, "boom"), ("b", "b", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, rel_path string, size long, content_hash string, exact_path string, near_path string, error string")
    assert [r.path for r in selection(df).collect()] == ["b"]


def test_link_at_destination_stays(spark, trees, tmpdir_path):
    ref, tgt, base = trees
    out = f"{base}/linked"
    os.makedirs(f"{out}/y")
    _w(f"{base}/elsewhere", b"other")
    os.symlink(f"{base}/elsewhere", f"{out}/y/notes.txt")
    res, _ = _run(spark, ref, tgt, out)
    assert os.path.islink(f"{out}/y/notes.txt") and res["y/notes.txt"].reason == f"Copied to {out}/y/notes_1.txt"


def test_file_uris_and_other_schemes(spark, trees, tmpdir_path):
    ref, tgt, base = trees
    run = dedupe(spark, f"file://{ref}", f"file://{tgt}", f"file://{base}/out")
    assert run.stats.first().exact_duplicates == 2
    with pytest.raises(ValueError):
        dedupe(spark, "hdfs://nowhere/ref", tgt, f"{base}/out")
    with pytest.raises(OSError):
        scan_tree(spark, f"{base}/missing")


def test_hidden_images_are_matched(spark, tmpdir_path):
    ref, tgt = f"{tmpdir_path}/r", f"{tmpdir_path}/t"
    _w(f"{ref}/sub/_ref.png", png_bytes(_img(11)))
    for name in ("plain.png", ".hidden.png", "_under.png", "_u/in.png"):
        _w(f"{tgt}/{name}", png_bytes(np.kron(_img(11), np.ones((2, 2)))))
    run = dedupe(spark, ref, tgt, f"{tmpdir_path}/o")
    assert {r.action for r in run.results.collect()} == {"phash_dup"} and run.results.count() == 4


def test_table_sides_need_a_provider_and_write_content(spark):
    rows = [("a.png", "a.png", "a.png", ".png", 5, None, "hello")]
    schema = "path string, rel_path string, name string, ext string, size long, mtime timestamp, content string"
    ref = spark.createDataFrame(rows, schema)
    tgt = spark.createDataFrame([("b.txt", "b.txt", "b.txt", ".txt", 3, None, "new"), *rows], schema)
    with pytest.raises(ValueError):
        dedupe(spark, ref, tgt)
    run = dedupe(spark, ref, tgt, enable_phash=False, dry_run=False)
    assert sorted((r.target_path, r.action) for r in run.results.collect()) == [("a.png", "exact_dup"), ("b.txt", "copied")]
    assert [(r.rel_path, r.content) for r in spark.read.parquet(run.accepted_dir).collect()] == [("b.txt", "new")]


def test_oversized_header_is_never_decoded(spark, tmpdir_path):
    import struct
    import zlib

    from twinsieve.sources.images import header_size, phash_provider

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    bomb = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 60000, 60000, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"") + chunk(b"IEND", b"")
    _w(f"{tmpdir_path}/bomb.png", bomb)
    _w(f"{tmpdir_path}/ok.png", png_bytes(_img(2)))
    assert header_size(f"{tmpdir_path}/bomb.png") == (60000, 60000)
    df = spark.createDataFrame([(f"{tmpdir_path}/bomb.png",), (f"{tmpdir_path}/ok.png",)], "path string")
    got = {os.path.basename(r.path): r.fp for r in phash_provider(spark)(df).collect()}
    assert got["bomb.png"] is None and got["ok.png"] is not None
    assert phash_provider(spark, 0)(df).where("fp is not null").count() == 0  # a limit of 0 is a limit


def test_content_is_never_shuffled(spark):
    from conftest import SF0001

    from twinsieve.functions.providers import text_simhash
    from twinsieve.operators.classify import match_targets
    from twinsieve.operators.filters import prepare_side
    from twinsieve.sources.fixtures import files_from_documents
    from twinsieve.sources.tables import read_table

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = files_from_documents(read_table(spark, SF0001, "documents"))  # not spread: a plain scan
        ref, tgt = (prepare_side(files.filter(files["side"] == s)) for s in ("ref", "target"))
        df = match_targets(ref, tgt, fingerprint=text_simhash())
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    inputs = re.findall(r"\) Exchange\s+Input \[\d+\]: (.*)", text)
    assert inputs and not any(re.search(r"\b(content|text)#", x) for x in inputs)


def test_contract_values():
    from twinsieve import config as C

    assert C.IGNORED_FILE_NAMES == (".DS_Store",) and C.IGNORED_NAME_PREFIXES == ("._",)
    assert C.IGNORED_DIR_NAMES == (".Trash", ".Spotlight-V100", ".fseventsd")
    assert C.IMAGE_EXTENSIONS == (".jpg", ".jpeg", ".png", ".heic", ".webp", ".tif", ".tiff")
    assert C.DEFAULT_THRESHOLD == 8 and C.DEFAULT_CHUNK_SIZE == 262144


def test_a_run_leaves_only_its_results(spark, trees, tmpdir_path):
    from twinsieve.session import checkpoint_dir

    ref, tgt, base = trees
    root = checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    run = dedupe(spark, ref, tgt, f"{base}/kept", results_dir=f"{base}/results", dry_run=False)
    left = [n for n in set(os.listdir(root)) - before if not n.endswith(".zip")]
    assert left == [], left
    assert run.results.count() == 7 and run.stats.first().total_scanned == 7 and run.plan.count() == 4
    assert {"plan", "table", "results", "copied"} <= set(os.listdir(f"{base}/results"))
