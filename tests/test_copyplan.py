"""Copy plan: collision join and first free numeric suffix."""

from twinsieve.operators.copyplan import copy_plan

SEL = "path string, rel_path string, size long, content string"
EX = "rel_path string, size long, content_hash string"


def _plan(spark, selected, existing):
    s = spark.createDataFrame(selected, SEL)
    e = spark.createDataFrame(existing, EX)
    return {r.src: (r.final_dst, r.op) for r in copy_plan(s, e).collect()}


def _h(s):
    import hashlib

    return hashlib.sha256(s.encode()).hexdigest()


def test_write_present_rename(spark):
    sel = [("t/a.jpg", "d/a.jpg", 1, "A"), ("t/b.jpg", "d/b.jpg", 1, "B"), ("t/c.jpg", "d/c.jpg", 1, "C")]
    ex = [("d/b.jpg", 1, _h("B")), ("d/c.jpg", 1, _h("X"))]
    assert _plan(spark, sel, ex) == {
        "t/a.jpg": ("d/a.jpg", "write"),
        "t/b.jpg": ("d/b.jpg", "already_present"),
        "t/c.jpg": ("d/c_1.jpg", "rename"),
    }


def test_first_gap(spark):
    sel = [("t/x.jpg", "x.jpg", 1, "A"), ("t/y.png", "y.png", 1, "A"), ("t/z", "z", 1, "A"), ("t/w.jpg", "w.jpg", 1, "A")]
    ex = [
        ("x.jpg", 2, "h"), ("x_1.jpg", 2, "h"), ("x_2.jpg", 2, "h"),   # {1,2} -> 3
        ("y.png", 2, "h"), ("y_1.png", 2, "h"), ("y_3.png", 2, "h"),   # {1,3} -> 2
        ("z", 2, "h"), ("z_2", 2, "h"), ("z_7", 2, "h"),               # {2,7} -> 1 (no suffix)
        ("w.jpg", 2, "h"), ("w_01.jpg", 2, "h"),                       # leading zero is not taken -> 1
    ]
    got = _plan(spark, sel, ex)
    assert got == {
        "t/x.jpg": ("x_3.jpg", "rename"),
        "t/y.png": ("y_2.png", "rename"),
        "t/z": ("z_1", "rename"),
        "t/w.jpg": ("w_1.jpg", "rename"),
    }


def test_planned_destinations_are_occupied(spark):
    # t/a_1.jpg is itself written to a_1.jpg, so the collision of a.jpg must skip to _2.
    sel = [("t/a.jpg", "a.jpg", 1, "A"), ("t/a_1.jpg", "a_1.jpg", 1, "B")]
    ex = [("a.jpg", 5, "h")]
    assert _plan(spark, sel, ex) == {"t/a.jpg": ("a_2.jpg", "rename"), "t/a_1.jpg": ("a_1.jpg", "write")}


def test_no_limit_on_numbers(spark):
    sel = [("t/m.jpg", "m.jpg", 1, "A"), ("t/n.jpg", "n.jpg", 1, "A")]
    ex = [("m.jpg", 5, "h")] + [(f"m_{k}.jpg", 5, "h") for k in range(1, 12001)]
    ex += [("n.jpg", 5, "h"), ("n_1.jpg", 5, "h"), ("n_" + "9" * 40 + ".jpg", 5, "h"), ("n_1234567890123.jpg", 5, "h")]
    assert _plan(spark, sel, ex) == {"t/m.jpg": ("m_12001.jpg", "rename"), "t/n.jpg": ("n_2.jpg", "rename")}


def test_entries_without_size_are_occupied(spark):
    # A link or a directory at the destination: never equal, never overwritten.
    assert _plan(spark, [("t/a", "a", 1, "A")], [("a", None, None)]) == {"t/a": ("a_1", "rename")}
