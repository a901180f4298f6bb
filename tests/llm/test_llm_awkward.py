"""Texts of very many lines or findings, repeated and missing ids: whole results in time that grows with the input."""

import random
import time

from llm_cases import docs, rows
from test_llm_documents import brute_fingerprint, brute_lines

from twinsieve.llm import line_runs, secret_cnn, simhash_pivot


def test_lines_of_a_very_long_text(spark):
    def took(n):
        text = "\n".join(f"line number {i} of the text" for i in range(n))
        data = [(1, text, "en", "s", 1, 1, "x", "y", "z", 2), (2, text + "\nits own last line", "en", "s", 1, 1, "x", "y", "z", 2)]
        df = docs(spark, data)
        at = time.time()
        got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_runs.drop_repeated_lines(df).collect())
        at = time.time() - at
        assert got == sorted(brute_lines([(1, text), (2, data[1][1])]))
        return at

    took(1_000)
    few, many = took(25_000), took(100_000)
    assert many < 4 * few + 10  # four times the lines


def test_findings_of_a_very_long_text():
    rnd = random.Random(4)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(50)]
    text = " ".join(f'token = "{rnd.choice(hexes)}" and abc{i}defgh12' for i in range(50_000))
    at = time.time()
    spans = secret_cnn.base_spans(text)
    cover = secret_cnn.Cover(spans)
    inside = [cover.overlaps(a, b) for a, b in secret_cnn.candidates(text)]
    assert len(spans) >= 50_000 and sum(inside) >= 50_000 and time.time() - at < 20


def test_cover_equals_all_pairs():
    rnd = random.Random(2)
    for _ in range(300):
        spans = sorted((a, a + rnd.randint(1, 6), "x") for a in (rnd.randint(0, 30) for _ in range(rnd.randint(0, 6))))
        cover = secret_cnn.Cover(spans)
        for a in range(36):
            for b in range(a + 1, 38):
                assert cover.overlaps(a, b) == any(s < b and a < e for s, e, _ in spans), (spans, a, b)


def brute_groups(data):
    """The rows of the groups of linked fingerprints."""
    fps = [brute_fingerprint(t) for _, t in data]
    left, groups = set(range(len(data))), []
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            i = todo.pop()
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 3}
            left -= near
            group |= near
            todo += near
        groups.append(group)
    return groups


def check_kept(spark, data):
    df = docs(spark, [(d, t, "en", "s", len(t or ""), 1, "x", "y", "z", 2) for d, t in data])
    out = simhash_pivot.keep_representatives(df)
    assert out.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = brute_groups(data)
    assert len(kept) == len(groups)
    for group in groups:
        members = [data[i] for i in group]
        mine = [k for k in kept if k in members]
        least = min((d for d, _ in members if d is not None), default=None)
        assert len(mine) == 1 and mine[0][0] == least, members


def test_one_row_of_every_group_stays(spark):
    one, two, three = ("the quick brown fox jumps over %s and away it goes again today" % x for x in ("it", "hedges at night", "seven lazy dogs there"))
    data = [(1, one), (1, two), (1, one), (2, one), (None, one), (None, three), (None, three), (3, two), (4, "all of its own here"),
            (4, "quite another text under this number"), (None, None), (5, ""), (6, "copy of a kind"), (None, "copy of a kind"), (7, one)]
    check_kept(spark, data)
    check_kept(spark, [(i, t) for i, (_, t) in enumerate(data)])  # unique ids: the plain way
    check_kept(spark, [(None, t) for _, t in data])


def test_stage_keeps_texts_under_a_repeated_id(spark):
    check_kept(spark, [(r[0], r[1]) for r in rows()])


def test_secrets_are_learned_from_few_findings_and_from_late_words(spark):
    # Eight labelled findings are enough to train on: no switch by their number.
    rows = [(i, "ordinary sentences here " * 5 + f"token = {'%032x' % ((i + 1) * 7919**8)} and then more") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert secret_cnn.train(df).threshold <= 1
    # A long word of every place of a text may be the negative, not only the first.
    texts = [(i, " ".join(f"ordinary{chr(97 + (i * j) % 26)}{chr(97 + j)}" for j in range(20))) for i in range(40)]
    at = [r["at"] for r in secret_cnn.plain_words(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert len(at) == 40 and len(set(at)) > 5 and max(at) > 100
