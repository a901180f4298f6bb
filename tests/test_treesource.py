"""The tree data source and the file-system view behind it, against the walk and plain os calls."""

import os
import re

import pytest
from pyspark.sql import functions as F

from twinsieve.sources.content import copy_files, hash_file
from twinsieve.sources.filesystems import ListedTree, copy_file, is_remote, mounted, tree_of
from twinsieve.sources.filetree import scan_tree
from twinsieve.sources.treesource import Condition, ext_of_name, read_tree

COLUMNS = ["path", "rel_path", "name", "ext", "size", "mtime", "error"]


@pytest.fixture()
def tree(tmpdir_path):
    root = f"{tmpdir_path}/tree"
    for i in range(60):
        folder = f"{root}/a{i % 3}/b{i % 5}" + "/deep" * (i % 4)
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/f{i}.{'JPG' if i % 2 else 'png'}", "wb") as f:
            f.write(b"x" * i)
    for name in (".hidden.jpg", "_under.png", "plain", "a.tar.GZ", "dot.", ".DS_Store"):
        with open(f"{root}/{name}", "wb") as f:
            f.write(name.encode())
    os.makedirs(f"{root}/.Trash/x")
    with open(f"{root}/.Trash/x/gone.png", "wb") as f:
        f.write(b"gone")
    os.symlink(f"{root}/plain", f"{root}/link")
    os.symlink(f"{root}/a0", f"{root}/linkdir")
    os.mkfifo(f"{root}/pipe")
    return root


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("planned", [1, 4, 512])
def test_source_equals_walk(spark, tree, planned):
    want = rows(scan_tree(spark, tree))
    assert len(want) == 66 and rows(read_tree(spark, tree, planned=planned)) == want
    assert rows(read_tree(spark, f"file://{tree}", planned=planned)) == want
    assert read_tree(spark, tree, planned=planned).rdd.getNumPartitions() <= max(1, planned)


def test_filters_reach_the_listing(spark, tree):
    whole = scan_tree(spark, tree)
    for condition in (
        "ext = '.jpg'", "ext in ('.jpg', '.png') and size > 10 and size <= 40", "name like 'f1%' and not (ext = '.png')", "name like '%.JPG'",
        "rel_path like '%deep/deep%' and size >= 7", "size < 3", "error is not null", "error is null and name = 'plain'", "size is not null and size = 5",
        "mtime > timestamp'2001-01-01 00:00:00' and size <> 8", "ext = ''", "size <=> 12", "not (name in ('f1.JPG', 'f3.JPG')) and size < 6",
    ):
        df = read_tree(spark, tree).where(condition)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
        assert pushed and "Filter (" not in plan, (condition, plan)  # every condition is the source's own
        assert rows(df) == rows(whole.where(condition)), condition
    both = read_tree(spark, tree).where("size > 10 and length(name) = 6")  # what the source cannot judge stays with Spark
    assert rows(both) == rows(whole.where("size > 10 and length(name) = 6"))
    assert rows(read_tree(spark, tree, pushdown="false").where("size > 10")) == rows(whole.where("size > 10"))


def test_names_are_judged_before_files_are_touched(tree):
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not

    from twinsieve.sources.treesource import FilteringTreeReader

    reader = FilteringTreeReader({"path": tree})
    unknown = EqualTo(("a", "b"), 1)
    assert list(reader.pushFilters([EqualTo(("ext",), ".jpg"), GreaterThan(("size",), 3), unknown, Not(EqualTo(("name",), "f1.JPG"))])) == [unknown]
    looked = []

    class Watched(type(tree_of(tree))):
        def stat(self, entry):
            looked.append(entry.path)
            return super().stat(entry)

    watched = Watched(tree)
    got = [r[2] for p in reader.partitions() for r in reader.rows(watched, reader.files(watched, p))]
    assert got and all(p.lower().endswith(".jpg") for p in looked) and "f1.JPG" not in got
    assert Condition.of(EqualTo(("size",), None)) is None


def test_extensions_follow_the_column_rule(spark):
    from twinsieve.functions.paths import ext_of

    names = ["a.jpg", ".jpg", "a.", "a.b.C", "noext", "..x", "a..b", "é.PNG", "."]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ext_of("n").alias("e")).collect()
    assert {r.n: r.e for r in got} == {n: ext_of_name(n) for n in names}


def test_listed_trees(spark, tree, tmpdir_path):
    """The view used for remote trees, on files that need no client: names, sizes and times of the same files."""
    os.remove(f"{tree}/link"), os.remove(f"{tree}/linkdir"), os.remove(f"{tree}/pipe")
    want = [r[:5] for r in rows(scan_tree(spark, tree))]
    assert [r[:5] for r in rows(scan_tree(spark, tree, listed=True))] == want
    assert [r[:5] for r in rows(read_tree(spark, tree, listing="arrow", planned=3))] == want
    remote = ListedTree(f"file://{tree}")
    assert remote.exists() and not ListedTree(f"file://{tree}/none").exists() and list(remote.children(f"{tree}/none")) == []
    with pytest.raises(OSError):
        ListedTree(f"file://{tree}/none").check()
    with pytest.raises(OSError):
        tree_of(f"{tree}/none").check()
    with pytest.raises(Exception, match="none"):
        read_tree(spark, f"{tree}/none").count()
    assert is_remote("hdfs://x/y") and not is_remote("file:///x") and mounted("file:///x/y") == "/x/y"


def test_copies_through_streams_equal_plain_ones(spark, tree, tmpdir_path):
    src = f"{tree}/plain"
    copy_file(src, f"{tmpdir_path}/out/sub/a", through=True)
    copy_file(src, f"{tmpdir_path}/out/sub/b")
    assert hash_file(f"{tmpdir_path}/out/sub/a") == hash_file(f"file://{tmpdir_path}/out/sub/b") == hash_file(src)
    with pytest.raises(OSError):
        copy_file(f"{tree}/missing", f"{tmpdir_path}/out/sub/c", through=True)
    assert sorted(os.listdir(f"{tmpdir_path}/out/sub")) == ["a", "b"]
    plan = spark.createDataFrame([(src, "x/y", "write"), (f"{tree}/missing", "z", "rename"), (src, "no", "already_present")], "src string, final_dst string, op string")
    got = {os.path.relpath(r.dst, tmpdir_path): r.error for r in copy_files(plan, f"file://{tmpdir_path}/out").collect()}
    assert got["out/x/y"] is None and got["out/z"] and not os.path.exists(f"{tmpdir_path}/out/no")


def test_lazy_and_reusable_frames(spark, tree):
    df = read_tree(spark, tree, side="ref").groupBy("side", "ext").agg(F.count("*").alias("n"))
    first = {r.ext: r.n for r in df.collect()}
    with open(f"{tree}/a0/new.png", "wb") as f:
        f.write(b"1")
    assert {r.ext: r.n for r in read_tree(spark, tree, side="ref").groupBy("ext").agg(F.count("*").alias("n")).collect()}[".png"] == first[".png"] + 1
