import hashlib

import duckdb
import numpy as np
import zstandard
from conftest import SF0001, SF001

from twinsieve.llm import cap_filters, nn_descent, queries, warc_zstd
from twinsieve.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int, cid string, n int, h1 long"


def brute_links(ids, vectors, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    link, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = cap_filters.unit(vectors[i]), cap_filters.unit(vectors[j])
                if a @ b >= least:
                    link[i] += 1
                    link[j] += 1
                    parent[find(j)] = find(i)
    groups = {}
    for i in range(n):
        if ids[i] is not None:
            groups[find(i)] = min(ids[i], groups.get(find(i), ids[i]))
    return sorted((str(ids[i]), link[i], str(groups.get(find(i)))) for i in range(n))


def clouds(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for centre in rng.normal(size=(12, 16)):
        for _ in range(12):
            rows.append((centre + rng.normal(scale=0.12, size=16)).tolist())
    rows += rng.normal(size=(60, 16)).tolist()
    rows += [rows[0]] * 5 + [[2 * x for x in rows[3]]]  # repeated and scaled vectors
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e-30] * 16, [1e30] * 16]
    ids = list(range(len(rows)))
    ids[5], ids[7] = None, 8
    return ids, [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in rows]


def test_cap_filters_equal_brute_force(spark):
    ids, vectors = clouds()
    df = spark.createDataFrame([(i, v, 0, "x", 1, 1) for i, v in zip(ids, vectors, strict=True)], VECTORS)
    for block in (2048, 8):  # small blocks: groups are compared chunk against chunk
        got = cap_filters.near_duplicates(df, block=block).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_links(ids, vectors)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0


def test_filters_at_the_threshold():
    """Pairs at cosine exactly 0.95 share a filter."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    met = np.zeros(len(a), dtype=bool)
    for seed in (11, 12):
        code = cap_filters.ProductCode(64, 14, seed)
        met |= (code.decode(a, 20)[:, :, None] == code.decode(b, 20)[:, None, :]).any((1, 2))
    assert met.mean() >= 0.999


def test_filters_of_large_tables_at_the_threshold():
    """The filters of 10^6 and 10^8 vectors miss no more of the pairs at cosine 0.95 than those of small tables."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(8000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for size in (29, 89):
        met = np.zeros(len(a), dtype=bool)
        for seed in range(11, 11 + cap_filters.rotations_for(size)):
            code = cap_filters.ProductCode(64, size, seed)
            met |= (code.decode(a, 20)[:, :, None] == code.decode(b, 20)[:, None, :]).any((1, 2))
        assert (~met).sum() <= 2


def test_ranked_sums_are_the_best_sums():
    rng = np.random.default_rng(2)
    a, b = -np.sort(-rng.normal(size=(50, 9))), -np.sort(-rng.normal(size=(50, 7)))
    top, _ = cap_filters.top_sums(a, np.tile(np.arange(9), (50, 1)), b, np.tile(np.arange(7), (50, 1)), 7, 12)
    assert np.allclose(top, -np.sort(-(a[:, :, None] + b[:, None, :]).reshape(50, -1))[:, :12])


def test_nearest_recall_and_scores(spark):
    p = queries.op8_nn_descent(spark, SF001).toPandas()
    e = duckdb.sql(f"select vec_id, embedding from '{SF001}/embeddings.parquet' order by vec_id").fetchall()
    a = np.array([v for _, v in e], dtype=np.float64)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    hit = n = 0
    for q in range(0, len(a), 50):
        s = a @ a[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(a)), -s))[:5]
        got = p[p.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(got.score, s[got.vec_id], atol=1e-12)
        hit, n = hit + len(set(got.vec_id) & set(best.tolist())), n + 5
    assert hit / n >= 0.95


def test_nearest_cases(spark):
    ids, vectors = clouds()
    df = spark.createDataFrame([(i, v, 0, "x", 1, 1) for i, v in zip(ids, vectors, strict=True)], VECTORS)
    got = nn_descent.nearest(df, lambda i: i % 3 == 0, k=8).toPandas()
    ok = {i: cap_filters.unit(v) for i, v in zip(ids, vectors, strict=True)
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q, rows in got.groupby("query_id"):
        want = sorted(((-(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]) and i != 8))[:5]
        rows = rows[rows.vec_id != 8].sort_values("rank")
        assert np.allclose(sorted(rows.score, reverse=True)[:3], [-s for s, _ in want][:3], atol=1e-9) or len(ok[q]) == 2
    assert nn_descent.nearest(df.limit(0), lambda i: i % 3 == 0).count() == 0
    one = nn_descent.nearest(df.where("vec_id in (0, 20)"), lambda i: i % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in one) == [(0, 1, 20), (20, 1, 0)]


def test_a_node_that_all_others_list_stays_bounded(spark):
    # Centre plus noise: the centre is in nearly every list.
    rng = np.random.default_rng(3)
    k, n = 8, 600
    centre = rng.normal(size=64)
    x = [centre, *(centre + rng.normal(scale=0.3, size=(n, 64)))]
    nodes = spark.createDataFrame([(i, bytearray(nn_descent.quantise(cap_filters.unit(v)))) for i, v in enumerate(x)], "id long, q binary")
    scratch = Scratch(spark, "t")
    lists = nn_descent.build_graph(nodes, scratch, k=k)
    listing = lists.selectExpr("explode(ids) as c").where("c = 0").count()
    assert listing > n / 2
    most = max(r["n"] for r in nn_descent._neighbourhoods(lists, 8, k).groupBy("c").agg({"*": "count"}).toDF("c", "n").collect())
    assert most <= 2 * k + 1
    assert max(len(r["nb"]) for r in nn_descent.adjacency(lists, scratch, k).collect()) <= 3 * k
    import pyarrow as pa
    many = pa.RecordBatch.from_pydict({"id": [1] * 5000, "q": [None] * 5000, "ids": [[i, i + 1] for i in range(5000)], "sims": [[i / 5000, (i + 1) / 5000] for i in range(5000)]})
    (_, _, old, top), = nn_descent.folded([many], 4)
    assert old == [0, 1] and [i for i, _ in top] == [5000, 4999, 4998, 4997]
    rows = [pa.RecordBatch.from_pydict({"c": [1] * 50, "m": list(range(50))})] * 4
    assert [(c, len(m)) for c, (m,) in nn_descent.runs(rows, "c", ["m"], 17)] == [(1, 17)]


def test_best_entries_of_nodes():
    """Equal ids once with their largest similarity, ties by id, both zeros equal, runs over several batches."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = [(int(n), rng.integers(-40, 40, m).tolist(), (rng.integers(-5, 6, m) / np.float32(7)).tolist()) for n, m in zip(np.sort(rng.integers(0, 9, 60)), rng.integers(0, 50, 60), strict=True)]
    rows[0] = (0, [7, 5], [-0.0, 0.0])
    want = {}
    for n, ids, sims in rows:
        best = want.setdefault(n, {})
        for i, s in zip(ids, sims, strict=True):
            best[i] = max(s, best.get(i, -9))
    want = {n: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:6] for n, best in want.items()}

    def batch(part):
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()))
        cols = list(zip(*((n, None, ids, sims) for n, ids, sims in part), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "q", "ids", "sims"])

    for size in (60, 7, 1):
        got = list(nn_descent.folded([batch(rows[i : i + size]) for i in range(0, 60, size)], 6))
        assert [(n, [i for i, _ in top]) for n, _, _, top in got] == [(n, [i for i, _ in best]) for n, best in sorted(want.items())]
    firsts = {}
    for n, ids, _ in rows:
        firsts.setdefault(n, ids)
    assert all(old == firsts[n] for n, _, old, _ in got)
    got = {}
    some = [r for r in rows if r[1]]
    for n, ids, sims in zip(*nn_descent.offers(np.array([r[0] for r in some]), np.array([len(r[1]) for r in some]), np.concatenate([r[1] for r in some]),
                                               np.concatenate([r[2] for r in some]).astype(np.float32), 6).to_pydict().values(), strict=True):
        got.setdefault(n, []).append(list(zip(ids, sims, strict=True)))
    total = {n: sum(len(r[1]) for r in some if r[0] == n) for n in got}
    assert any(t > 48 for t in total.values())
    for n, lists in got.items():
        if total[n] > 48:  # many entries in one task: left with the best
            assert [i for i, _ in lists[0]] == [i for i, _ in want[n]] and len(lists) == 1
        else:
            assert sum(map(len, lists)) == total[n]


def test_a_round_shuffles_offers_and_reverse_links_once(spark):
    rows = [(i, bytearray(4), [1], [0.5], [True]) for i in range(4)]
    state = spark.createDataFrame(rows, nn_descent.STATE)
    shuffles = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").count("Exchange hash")
    assert shuffles(nn_descent._merge(state, state.select("id", "ids", "sims"), 8, 4)) == 1
    edges = state.selectExpr("ids[0] as c", "id as m")
    cut = nn_descent.first_rows(edges, ["m"], 4)
    assert shuffles(cut) == 1 and cut.count() == 4
    assert "WindowGroupLimit" in spark._jvm.PythonSQLUtils.explainString(cut._jdf.queryExecution(), "simple")


def test_rounds_try_other_reverse_links_until_settled(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)) + 2
    nodes = spark.createDataFrame([(i, bytearray(nn_descent.quantise(cap_filters.unit(v)))) for i, v in enumerate(x)], "id long, q binary")
    lists = nn_descent.build_graph(nodes, Scratch(spark, "t"), k=4, tables=1, window=8)
    changed, entries = lists.selectExpr("sum(size(filter(fresh, x -> x)))", "sum(size(ids))").first()
    assert changed <= 0.01 * entries
    sizes = lists.selectExpr("explode(ids) as c").groupBy("c").count().orderBy("count", ascending=False).first()
    assert sizes["count"] > 10
    seen = [{r["m"] for r in nn_descent._neighbourhoods(lists, 8, 4, t).where(f"c = {sizes['c']} and kind = 1").collect()} for t in range(6)]
    assert all(len(m) == 5 for m in seen) and len(set.union(*seen)) > 5


def pages(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (None, "u\nv", "x"), (3, "q", None), (4, "q", ""), (5, "z", "é" * 200000), (5, "z", "é" * 200000),
            (None, "n", "solo"), (None, "n", "solo")]
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, frame int, digest string")


def test_archives_round_trip(spark):
    got = warc_zstd.archive_and_read(pages(spark)).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted(
        [("1", 1, "revisit", 2), ("2", 1, "response", None), ("None", 1, "revisit", 2), ("3", 0, "revisit", 4), ("4", 0, "response", None),
         ("5", 400000, "response", None), ("5", 400000, "response", None), ("None", 4, "response", None), ("None", 4, "response", None)])
    assert all(r["payload_digest"] == warc_zstd.digest_of(b"x") for r in got if r["payload_bytes"] == 1)
    assert warc_zstd.archive_and_read(pages(spark).limit(0)).count() == 0


def test_bundles_seek_and_decompress_whole(spark):
    scratch = Scratch(spark, "t")
    folder = scratch.folder("b")
    warc_zstd.write_bundles(pages(spark), folder, scratch, frame_bytes=200, bundle_bytes=300)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).collect()
    assert sum(len(warc_zstd.BundleReader(bytes(f["content"])).records) for f in files) == 9
    for f in files:
        data = bytes(f["content"])
        reader = warc_zstd.BundleReader(data)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # any reader skips the tables
        assert whole == b"".join(reader.frame(i) for i in range(len(reader.frames)))
        assert whole.startswith(b"WARC/1.1\r\n")
    some = warc_zstd.read_records(spark, folder, ["2"]).collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in some] == [("2", b"x")]


def test_query_payloads_match_table(spark):
    got = {r["page_id"]: r for r in queries.op6_warc_zstd(spark, SF0001).collect()}
    for i, html in duckdb.sql(f"select page_id, html from '{SF0001}/pages.parquet'").fetchall():
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == warc_zstd.digest_of(raw)
        assert len(got[i]["payload_digest"]) == 32 and hashlib.sha1(raw).hexdigest()
