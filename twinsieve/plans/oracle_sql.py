"""DuckDB SQL for every fixture query, written independently of the Spark plans.

Each statement is self-contained over the pre-registered driver views and
runs on whole tables.  Near matching is written the plain way (OR of chunk
equalities for ``lsh``; brute-force distance over all pairs for ``complete``),
which is what the Spark band joins must reproduce.
"""

from __future__ import annotations

import math
import re

from ..config import (
    DEFAULT_THRESHOLD,
    IGNORED_DIR_NAMES,
    IGNORED_FILE_NAMES,
    IGNORED_NAME_PREFIXES,
    IMAGE_EXTENSIONS,
)
from ..sources.fixtures import FIXTURE_SUFFIXES

EXT_FILTER_SPEC = ".jpg, PNG,"  # normalised to ('.jpg', '.png')
EXT_FILTER = (".jpg", ".png")
OUT_DIR = "out"
TREE_EXTENSIONS, TREE_LEAST = (".jpg", ".png", ".heic"), 400  # what tree_scan asks for


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(items) -> str:
    return "(" + ", ".join(_q(x) for x in items) + ")"


SFX_CASE = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {_q(s)}" for i, s in enumerate(FIXTURE_SUFFIXES[:-1])) + f" ELSE {_q(FIXTURE_SUFFIXES[-1])} END"

FILES_CTE = f"""files AS (
  SELECT doc_id, side, rel_path AS path, rel_path, name,
         lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext, size, mtime, content
  FROM (
    SELECT doc_id, side, rel_path, regexp_extract(rel_path, '[^/]*$', 0) AS name, size, mtime, content
    FROM (
      SELECT doc_id,
        CASE WHEN doc_id % 2 = 0 THEN 'ref' ELSE 'target' END AS side,
        CASE WHEN doc_id % 50 IN (7, 8) THEN base || '/._doc_' || CAST(doc_id AS VARCHAR) || '.jpg'
             WHEN doc_id % 50 IN (11, 12) THEN base || '/d' || CAST(doc_id AS VARCHAR) || '/.DS_Store'
             WHEN doc_id % 50 IN (13, 14) THEN base || '/.Trash/doc_' || CAST(doc_id AS VARCHAR) || sfx
             ELSE base || '/doc_' || CAST(doc_id AS VARCHAR) || sfx END AS rel_path,
        CAST(strlen(text) AS BIGINT) AS size,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS mtime,
        text AS content
      FROM (SELECT doc_id, text, source || '/' || lang AS base, {SFX_CASE} AS sfx FROM documents) d
    ) a
  ) b
)"""

_dir_alt = "|".join(re.escape(d) for d in IGNORED_DIR_NAMES)
KEEP = (
    "NOT (name IN " + _in_list(IGNORED_FILE_NAMES)
    + "".join(f" OR starts_with(name, {_q(p)})" for p in IGNORED_NAME_PREFIXES)
    + f") AND NOT regexp_matches(rel_path, '(^|/)({_dir_alt})/')"
)
IMAGE = "ext IN " + _in_list(IMAGE_EXTENSIONS)

SIDES = f"""{FILES_CTE},
ref AS (SELECT * FROM files WHERE side = 'ref' AND {KEEP}),
tgt AS (SELECT * FROM files WHERE side = 'target' AND {KEEP})"""


def simhash_cte(name: str, src: str, key: str = "path", text: str = "content") -> str:
    """CTEs ``{name}`` (key, fp UBIGINT) with the 64-bit SimHash of each row of ``src``."""
    sums = ", ".join(f"sum(((h >> {i}) & 1)::INTEGER) AS s{i}" for i in range(64))
    bits = " | ".join(f"(CASE WHEN 2 * s{i} > n THEN (1::UBIGINT << {i}) ELSE 0::UBIGINT END)" for i in range(64))
    return f"""{name}_tok AS (
  SELECT {key} AS k, unnest(string_split(replace(replace({text}, chr(10), ' '), chr(9), ' '), ' ')) AS w FROM {src}),
{name}_h AS (SELECT k, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM {name}_tok WHERE w <> ''),
{name}_s AS (SELECT k, count(*) AS n, {sums} FROM {name}_h GROUP BY k),
{name} AS (SELECT k AS {key}, ({bits}) AS fp FROM {name}_s)"""


def chunks_sql(fp: str, prefix: str = "c") -> str:
    return ", ".join(f"CAST(({fp} >> {16 * k}) & 65535 AS INTEGER) AS {prefix}{k}" for k in range(4))


def _lsh_on(a: str, b: str) -> str:
    return " OR ".join(f"(({a} >> {16 * k}) & 65535) = (({b} >> {16 * k}) & 65535)" for k in range(4))


def near_ctes(threshold: int = DEFAULT_THRESHOLD, mode: str = "lsh") -> str:
    """Needs CTE ``t2`` (targets with exact_path).  Defines rfp, tfp, ref_idx, pairs, best."""
    on = _lsh_on("t.fp", "r.fp") if mode == "lsh" else "TRUE"
    return f"""ref_img AS (SELECT path, content FROM ref WHERE {IMAGE}),
cand AS (SELECT path, content FROM t2 WHERE exact_path IS NULL AND {IMAGE}),
{simhash_cte("rfp", "ref_img")},
{simhash_cte("tfp", "cand")},
ref_idx AS (SELECT fp, min(path) AS ref_path, count(*) AS n_files FROM rfp WHERE fp IS NOT NULL GROUP BY fp),
pairs AS (
  SELECT t.path, r.fp AS ref_fp, r.ref_path, CAST(bit_count(xor(t.fp, r.fp)) AS INTEGER) AS distance
  FROM tfp t JOIN ref_idx r ON ({on})),
best AS (
  SELECT path, ref_path AS near_path, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY distance, ref_path) AS rn
    FROM pairs WHERE distance <= {threshold} OR distance = 0) x
  WHERE rn = 1)"""


EXACT_CTES = """ref_hash AS (SELECT sha256(content) AS content_hash, min(path) AS exact_path FROM ref GROUP BY 1),
t1 AS (SELECT t.*, CASE WHEN t.size IN (SELECT size FROM ref) THEN sha256(t.content) END AS content_hash FROM tgt t),
t2 AS (SELECT t1.*, rh.exact_path FROM t1 LEFT JOIN ref_hash rh ON t1.content_hash = rh.content_hash)"""


def _result_select(src: str, near: bool = True) -> str:
    np_ = "near_path" if near else "CAST(NULL AS VARCHAR)"
    d = "distance" if near else "CAST(NULL AS INTEGER)"
    return f"""SELECT path AS target_path,
  CASE WHEN exact_path IS NOT NULL THEN 'exact_dup' WHEN {np_} IS NOT NULL THEN 'phash_dup' ELSE 'copied' END AS action,
  COALESCE(exact_path, {np_}, '') AS match_path,
  CASE WHEN exact_path IS NOT NULL THEN 'exact' WHEN {np_} IS NOT NULL THEN 'phash' ELSE 'none' END AS match_type,
  CASE WHEN exact_path IS NOT NULL THEN substr(content_hash, 1, 16)
       WHEN {np_} IS NOT NULL THEN CAST({d} AS VARCHAR)
       ELSE COALESCE(substr(content_hash, 1, 16), '') END AS distance_or_hash,
  CASE WHEN exact_path IS NOT NULL THEN 'Byte-identical match in reference'
       WHEN {np_} IS NOT NULL THEN 'Perceptual match (distance=' || CAST({d} AS VARCHAR) || ')'
       ELSE '[DRY-RUN] Would copy to {OUT_DIR}/' || rel_path END AS reason
FROM {src}"""


def classify_ctes(threshold: int = DEFAULT_THRESHOLD, mode: str = "lsh") -> str:
    """CTE list (after WITH) ending in ``res``: the classification result."""
    return f"""{SIDES},
{EXACT_CTES},
{near_ctes(threshold, mode)},
m AS (SELECT t2.*, b.near_path, b.distance FROM t2 LEFT JOIN best b ON t2.path = b.path),
res AS ({_result_select("m")})"""


def classify_sql(threshold: int = DEFAULT_THRESHOLD, mode: str = "lsh") -> str:
    return f"WITH {classify_ctes(threshold, mode)}\nSELECT * FROM res"


def _with(body_ctes: str, select: str) -> str:
    return f"WITH {SIDES}{',' if body_ctes else ''}\n{body_ctes}\n{select}"


def _vector_chunks_sql() -> str:
    terms = []
    for k in range(4):
        parts = " + ".join(
            f"(CASE WHEN CAST(e[{16 * k + j + 1}] AS DOUBLE) > med THEN {1 << j} ELSE 0 END)" for j in range(16)
        )
        terms.append(f"CAST({parts} AS INTEGER) AS c{k}")
    return f"""SELECT vec_id, {", ".join(terms)}
FROM (
  SELECT vec_id, e, (CAST(s[(n - 1) // 2 + 1] AS DOUBLE) + CAST(s[n // 2 + 1] AS DOUBLE)) / 2.0 AS med
  FROM (SELECT vec_id, embedding AS e, list_sort(embedding) AS s, len(embedding) AS n FROM embeddings) x
) y"""


def _copy_ctes(selected: str) -> str:
    """CTEs of the copy plan of ``selected`` (src, planned_dst, size, content), ending in ``plan``."""
    return f"""selected AS ({selected}),
alltgt AS (SELECT * FROM tgt),
parts AS (
  SELECT doc_id, rel_path, content,
         regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS d,
         regexp_extract(rel_path, '[^/]*$', 0) AS nm
  FROM alltgt),
parts2 AS (
  SELECT *, regexp_extract(nm, '^.+(\\.[^.]+)$', 1) AS sf FROM parts),
existing AS (
  SELECT rel_path, size, content_hash FROM (
    SELECT rel_path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS content_hash FROM alltgt WHERE doc_id % 10 = 1
    UNION ALL
    SELECT rel_path, CAST(strlen(content || 'x') AS BIGINT), sha256(content || 'x') FROM alltgt WHERE doc_id % 10 = 3
    UNION ALL
    SELECT CASE WHEN d = '' THEN '' ELSE d || '/' END || substr(nm, 1, length(nm) - length(sf)) || '_1' || sf,
           CAST(strlen(content || 'x') AS BIGINT), sha256(content || 'x') FROM parts2 WHERE doc_id % 20 = 3
    UNION ALL
    SELECT CASE WHEN d = '' THEN '' ELSE d || '/' END || substr(nm, 1, length(nm) - length(sf)) || '_3' || sf,
           CAST(strlen(content || 'x') AS BIGINT), sha256(content || 'x') FROM parts2 WHERE doc_id % 60 = 3
  ) e),
planned AS (
  SELECT s.src, s.planned_dst,
    CASE WHEN e.size IS NULL THEN 'write'
         WHEN e.size = s.size AND sha256(s.content) = e.content_hash THEN 'already_present'
         ELSE 'rename' END AS op
  FROM selected s LEFT JOIN existing e ON s.planned_dst = e.rel_path),
ren AS (
  SELECT src, planned_dst, d, substr(nm, 1, length(nm) - length(sf)) AS stem, sf FROM (
    SELECT src, planned_dst, regexp_extract(planned_dst, '^(.*)/[^/]*$', 1) AS d,
           regexp_extract(planned_dst, '[^/]*$', 0) AS nm,
           regexp_extract(regexp_extract(planned_dst, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1) AS sf
    FROM planned WHERE op = 'rename') x),
occupied AS (SELECT rel_path FROM existing UNION SELECT planned_dst FROM selected),
k_ok AS (
  SELECT r.src, k.k
  FROM ren r, range(1, (SELECT count(*) + 2 FROM occupied)) k(k)
  WHERE (CASE WHEN r.d = '' THEN '' ELSE r.d || '/' END || r.stem || '_' || CAST(k.k AS VARCHAR) || r.sf)
        NOT IN (SELECT rel_path FROM occupied)),
first_k AS (SELECT src, min(k) AS k FROM k_ok GROUP BY src),
plan AS (SELECT p.src, p.planned_dst,
  CASE WHEN p.op <> 'rename' THEN p.planned_dst
       ELSE (CASE WHEN r.d = '' THEN '' ELSE r.d || '/' END || r.stem || '_' || CAST(f.k AS VARCHAR) || r.sf) END AS final_dst,
  p.op
FROM planned p LEFT JOIN ren r ON p.src = r.src LEFT JOIN first_k f ON p.src = f.src)"""


def copy_plan_sql() -> str:
    return f"""WITH {classify_ctes()},
{_copy_ctes("""SELECT t.path AS src, t.rel_path AS planned_dst, t.size, t.content, t.doc_id
             FROM res JOIN tgt t ON res.target_path = t.path WHERE res.action = 'copied'""")}
SELECT * FROM plan"""


# The full run's fixture: these targets cannot be read.
UNREADABLE = "doc_id % 50 = 21"


def run_ctes() -> str:
    """The full run (not dry) up to ``final``: one row per target with its outcome."""
    return f"""{classify_ctes()},
bad AS (SELECT path FROM tgt WHERE {UNREADABLE}),
{_copy_ctes("""SELECT t.path AS src, t.rel_path AS planned_dst, t.size, t.content, t.doc_id
             FROM res JOIN tgt t ON res.target_path = t.path WHERE res.action = 'copied' AND t.path NOT IN (SELECT path FROM bad)""")},
final AS (
  SELECT res.target_path,
    CASE WHEN bad.path IS NOT NULL THEN 'skipped' ELSE action END AS action,
    CASE WHEN bad.path IS NOT NULL THEN '' ELSE match_path END AS match_path,
    CASE WHEN bad.path IS NOT NULL THEN '' ELSE match_type END AS match_type,
    CASE WHEN bad.path IS NOT NULL THEN '' ELSE distance_or_hash END AS distance_or_hash,
    CASE WHEN bad.path IS NOT NULL THEN 'Error: Failed to hash ' || res.target_path || ': unreadable'
         WHEN action = 'copied' THEN 'Copied to {OUT_DIR}/' || p.final_dst ELSE reason END AS reason,
    p.op, p.final_dst
  FROM res LEFT JOIN bad ON res.target_path = bad.path LEFT JOIN plan p ON res.target_path = p.src)"""


def image_phash_sql(side: int = 8, scale: int = 8, out: int = 32) -> str:
    """pHash bits of the vectors' images, from kernel and cosine tables written out as numbers.

    An image is ``side x side`` blocks of equal pixels, so a pass needs one weight a block: the sum of the kernel's
    rounded 22-bit weights over its pixels.  Independent of the Spark side: plain integer and double arithmetic."""
    size, support = side * scale, 3.0 * side * scale / out

    def lanczos(x: float) -> float:
        if x == 0:
            return 1.0
        return math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if abs(x) < 3 else 0.0

    kernel, cosine = [], []
    for i in range(out):
        center = (i + 0.5) * size / out
        span = range(max(0, int(center - support + 0.5)), min(size, int(center + support + 0.5)))
        k = {x: lanczos((x - center + 0.5) * out / size) for x in span}
        whole = {x: int(v / sum(k.values()) * (1 << 22) + (0.5 if v >= 0 else -0.5)) for x, v in k.items()}
        kernel += [f"({i}, {b}, {sum(whole.get(x, 0) for x in range(b * scale, (b + 1) * scale))})" for b in range(side)]
        cosine += [f"({u}, {i}, {math.cos(math.pi * u * (2 * i + 1) / (2 * out))!r}::DOUBLE)" for u in range(8)]
    byte = "greatest(0, least(255, (2097152 + sum({} * w)::BIGINT) >> 22))"
    bits = "sum(CASE WHEN d > med AND 8 * u + v BETWEEN {} AND {} THEN 1 << (63 - 8 * u - v - {}) ELSE 0 END)::INTEGER AS c{}"
    chunks = ", ".join(bits.format(48 - 16 * c, 63 - 16 * c, 16 * c, c) for c in range(4))
    return f"""WITH kernel(o, b, w) AS (VALUES {", ".join(kernel)}),
cosine(u, i, c) AS (VALUES {", ".join(cosine)}),
pixels AS (
  SELECT vec_id, p // {side} AS y, p % {side} AS x,
    CASE WHEN hi > lo THEN round((embedding[p + 1]::DOUBLE - lo) / (hi - lo) * 255)::BIGINT ELSE 0 END AS g
  FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, unnest(range({side * side})) AS p FROM embeddings) e),
across AS (SELECT vec_id, y, o AS x, {byte.format("g")} AS g FROM pixels JOIN kernel ON x = b GROUP BY vec_id, y, o),
down AS (SELECT vec_id, o AS y, x, {byte.format("g")} AS g FROM across JOIN kernel ON y = b GROUP BY vec_id, o, x),
rows_ AS (SELECT vec_id, y, u AS v, sum(g * c) AS s FROM down JOIN cosine ON x = i GROUP BY vec_id, y, u),
dct AS (SELECT vec_id, u, v, sum(s * c) AS d FROM rows_ JOIN cosine ON y = i GROUP BY vec_id, u, v),
hashed AS (SELECT vec_id, {chunks} FROM (SELECT *, median(d) OVER (PARTITION BY vec_id) AS med FROM dct) m GROUP BY vec_id)
SELECT e.vec_id, TRUE AS decoded, min(e.vec_id) OVER (PARTITION BY embedding) AS first_equal, c0, c1, c2, c3 FROM embeddings e JOIN hashed USING (vec_id)"""


def all_sql() -> dict[str, str]:
    t = DEFAULT_THRESHOLD
    near_base = f"""{EXACT_CTES},
{near_ctes(t, "lsh")}"""
    q: dict[str, str] = {}
    q["file_manifest"] = f"WITH {FILES_CTE}\nSELECT side, path, rel_path, name, ext, size, epoch_ms(mtime) AS mtime_ms FROM files"
    q["filter_ignored"] = f"WITH {FILES_CTE}\nSELECT side, path, name, ext, size FROM files WHERE {KEEP}"
    q["filter_extensions"] = _with("", f"SELECT side, path, ext FROM (SELECT * FROM ref UNION ALL SELECT * FROM tgt) x WHERE ext IN {_in_list(EXT_FILTER)}")
    q["image_files"] = _with("", f"SELECT side, path, ext FROM (SELECT * FROM ref UNION ALL SELECT * FROM tgt) x WHERE {IMAGE}")
    q["path_parts"] = f"""WITH {FILES_CTE}
SELECT path, name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
  substr(name, 1, length(name) - length(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) AS stem,
  regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix, ext FROM files"""
    q["size_buckets"] = _with("", "SELECT size, count(*) AS n_files FROM ref GROUP BY size")
    q["content_hash"] = _with("", "SELECT side, path, size, sha256(content) AS content_hash FROM (SELECT * FROM ref UNION ALL SELECT * FROM tgt) x")
    q["hash_groups"] = _with("", "SELECT sha256(content) AS content_hash, min(size) AS size, count(*) AS n_paths, min(path) AS first_path FROM ref GROUP BY 1")
    q["size_semi_join"] = _with("", "SELECT path, size FROM tgt WHERE size IN (SELECT size FROM ref)")
    q["exact_duplicates"] = _with(EXACT_CTES, "SELECT path AS target_path, exact_path AS match_path, content_hash FROM t2 WHERE exact_path IS NOT NULL")
    q["classify_bytes_only"] = _with(EXACT_CTES, _result_select("t2", near=False))
    q["fingerprint64"] = f"WITH {simhash_cte('sh', 'documents', key='doc_id', text='text')}\nSELECT d.doc_id, {chunks_sql('sh.fp')} FROM documents d LEFT JOIN sh ON d.doc_id = sh.doc_id"
    q["fingerprint64_vectors"] = _vector_chunks_sql()
    q["phash_groups"] = _with(near_base, f"SELECT {chunks_sql('fp')}, n_files, ref_path FROM ref_idx")
    q["chunk_index"] = _with(
        near_base,
        "SELECT band, val, count(*) AS n_hashes, min(ref_path) AS first_path FROM ("
        + " UNION ALL ".join(f"SELECT {k} AS band, CAST((fp >> {16 * k}) & 65535 AS INTEGER) AS val, ref_path FROM ref_idx" for k in range(4))
        + ") x GROUP BY band, val",
    )
    q["phash_exact_match"] = _with(near_base, "SELECT t.path AS target_path, r.ref_path AS match_path FROM tfp t JOIN ref_idx r ON t.fp = r.fp")
    q["lsh_candidates"] = _with(near_base, "SELECT path AS target_path, ref_path, distance FROM pairs")
    q["candidate_counts"] = _with(near_base, "SELECT c.path AS target_path, CAST(count(p.ref_fp) AS BIGINT) AS n_candidates FROM tfp c LEFT JOIN pairs p ON c.path = p.path GROUP BY c.path")
    q["best_perceptual_match"] = _with(near_base, "SELECT path AS target_path, near_path AS match_path, distance FROM best")
    q["hamming_complete"] = _with(f"{EXACT_CTES},\n{near_ctes(t, 'complete')}", "SELECT path AS target_path, near_path AS match_path, distance FROM best")
    fp_sel = "SELECT 'ref' AS ref_path, count(*) AS file_count, CAST(COALESCE(sum(size), 0) AS BIGINT) AS total_bytes, epoch_ms(COALESCE(max(mtime), TIMESTAMP '1970-01-01')) AS max_mtime_ms FROM ref"
    q["reference_fingerprint"] = _with("", fp_sel)
    q["fingerprints_match"] = _with(
        "",
        f"""SELECT 'unchanged' AS state, TRUE AS matches
UNION ALL SELECT 'newest_touched', (SELECT max(mtime) FROM ref) = (SELECT max(mtime) + INTERVAL 1 SECOND FROM ref)
UNION ALL SELECT 'images_only', (SELECT count(*) FROM ref) = (SELECT count(*) FROM ref WHERE {IMAGE})
  AND (SELECT sum(size) FROM ref) = (SELECT sum(size) FROM ref WHERE {IMAGE})
UNION ALL SELECT 'target_tree', (SELECT count(*) FROM ref) = (SELECT count(*) FROM tgt)
  AND (SELECT sum(size) FROM ref) = (SELECT sum(size) FROM tgt) AND (SELECT max(mtime) FROM ref) = (SELECT max(mtime) FROM tgt)""",
    )
    q["index_stats"] = _with(
        near_base,
        """SELECT (SELECT count(*) FROM ref) AS total_files, (SELECT count(DISTINCT size) FROM ref) AS size_buckets,
  (SELECT count(*) FROM ref_idx) AS unique_phashes, (SELECT CAST(COALESCE(sum(n_files), 0) AS BIGINT) FROM ref_idx) AS indexed_images""",
    )
    q["index_roundtrip"] = _with("", "SELECT sha256(content) AS content_hash, size, path FROM ref")
    q["classify"] = classify_sql(t, "lsh")
    q["classify_complete"] = classify_sql(t, "complete")
    q["run_stats"] = f"""WITH r AS ({classify_sql(t, "lsh")})
SELECT count(*) AS total_scanned, count(*) FILTER (WHERE action = 'copied') AS copied,
  count(*) FILTER (WHERE action = 'exact_dup') AS exact_duplicates,
  count(*) FILTER (WHERE action = 'phash_dup') AS phash_duplicates,
  count(*) FILTER (WHERE action = 'skipped') AS skipped FROM r"""
    q["unique_rows"] = f"""WITH {classify_ctes(t, "lsh")}
SELECT t.path, t.rel_path, t.size FROM tgt t JOIN res ON t.path = res.target_path WHERE res.action = 'copied'"""
    q["copy_plan"] = copy_plan_sql()
    q["dedupe_run"] = f"""WITH {run_ctes()}
SELECT target_path, action, match_path, match_type, distance_or_hash, reason,
  CASE WHEN op IN ('write', 'rename') THEN sha256(t.content) END AS accepted_sha256
FROM final f JOIN tgt t ON f.target_path = t.path"""
    q["accepted_content"] = f"""WITH {run_ctes()}
SELECT final_dst AS rel_path, target_path AS src, t.size, sha256(t.content) AS sha256, epoch_ms(t.mtime) AS mtime_ms
FROM final f JOIN tgt t ON f.target_path = t.path WHERE op IN ('write', 'rename')"""
    q["content_hash_blake2b"] = _with("", """SELECT side, path, size, 128 AS digest_chars,
  min(path) OVER (PARTITION BY content) AS first_path FROM (SELECT * FROM ref UNION ALL SELECT * FROM tgt) x""")
    q["image_phash"] = image_phash_sql()
    q["results_csv_roundtrip"] = classify_sql(t, "lsh")
    q["stream_classify"] = classify_sql(t, "lsh")
    q["tree_scan"] = f"""WITH {FILES_CTE}
SELECT side, rel_path, name, ext, size, epoch_ms(mtime) AS mtime_ms FROM files WHERE {KEEP} AND ext IN {_in_list(TREE_EXTENSIONS)} AND size >= {TREE_LEAST}"""
    q["tree_run"] = f"""WITH r AS ({q["classify_bytes_only"]})
SELECT target_path, action, match_path, match_type, distance_or_hash,
  CASE WHEN action = 'copied' THEN 'Copied to {OUT_DIR}/' || target_path ELSE reason END AS reason,
  CASE WHEN action = 'copied' THEN sha256(t.content) END AS copied_sha256
FROM r JOIN (WITH {SIDES} SELECT path, content FROM tgt) t ON r.target_path = t.path"""
    q["tree_ranges"] = f"""WITH r AS ({q["classify_bytes_only"]})
SELECT target_path, action, match_path, match_type, CASE WHEN action = 'exact_dup' THEN distance_or_hash ELSE '' END AS digest FROM r"""
    q["index_update"] = f"""WITH {SIDES}
SELECT path, size, sha256(content) AS content_hash,
  (SELECT count(*) FROM ref WHERE doc_id % 7 = 0 OR doc_id % 11 = 0) AS n_changed,
  (SELECT count(*) FROM tgt WHERE doc_id % 30 = 1) AS n_gone FROM ref"""
    q["stream_files"] = q["classify_bytes_only"]
    return q
