"""DuckDB SQL with the expected result of each query.

Written from the rules, not from the Spark plans: text is cleaned step by step,
splits rank whole classes with windows, and model arithmetic is joins and sums
over (row, dimension, value).
"""

from __future__ import annotations

import hashlib
import math

SPACE = r"\p{Z}\t-\r\x{1c}-\x{1f}\x{85}"

DOCS = """
tickets AS (
  SELECT d.doc_id AS row_id, d.text AS text_obr, d.lang AS category, d.source AS issue,
         'len' || CAST(CAST(floor(log2(d.n_chars)) AS INT) AS VARCHAR) AS subissue,
         CASE WHEN l.doc_id IS NULL THEN 'n/a'
              ELSE CAST(4 + l.quality - 2 * l.toxic AS VARCHAR) END AS grade
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

ITEMS = """
items AS (
  SELECT p_type AS category, p_brand AS issue, p_name AS subissue
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

VECTORS = """
vec AS (
  SELECT vec_id AS row_id, embedding, CAST(label // 2 AS INT) AS category, CAST(label AS INT) AS label
  FROM embeddings
),
xl AS (
  SELECT row_id, category, label, unnest(embedding)::DOUBLE AS v,
         generate_subscripts(embedding, 1) AS d
  FROM vec
)"""


def clean(column: str) -> str:
    sql = f"regexp_replace({column}, 'https?://[^{SPACE}]+', ' ', 'g')"
    sql = f"regexp_replace({sql}, '[^{SPACE}]+@[^{SPACE}]+', ' ', 'g')"
    sql = rf"regexp_replace({sql}, '\p{{Nd}}+', ' ', 'g')"
    sql = rf"regexp_replace({sql}, '[^\p{{L}}\p{{N}}_{SPACE}]+', ' ', 'g')"
    sql = f"trim(regexp_replace(lower({sql}), '[{SPACE}]+', ' ', 'g'))"
    return f"coalesce(nullif({sql}, ''), ' ')"


def safe_key(column: str) -> str:
    norm = f"trim(regexp_replace({column}, '[{SPACE}]+', ' ', 'g'))"
    return (
        rf"substring(regexp_replace({norm}, '[^\p{{L}}\p{{N}}_.\-]+', '_', 'g'), 1, 80)"
        f" || '__' || substring(md5({norm}), 1, 8)"
    )


def unique_names(source: str) -> str:
    """``named``: rows of ``source`` with ``subu`` and ``amb``."""
    return f"""
amb AS (
  SELECT subissue FROM {source} WHERE subissue IS NOT NULL
  GROUP BY 1 HAVING count(DISTINCT issue) > 1
),
named AS (
  SELECT s.*, a.subissue IS NOT NULL AS amb,
         CASE WHEN a.subissue IS NOT NULL
              THEN coalesce(s.subissue, 'nan') || ' ⟨' || coalesce(s.issue, 'nan') || '⟩'
              ELSE coalesce(s.subissue, 'nan') END AS subu
  FROM {source} s LEFT JOIN amb a ON coalesce(s.subissue, 'nan') = a.subissue
)"""


def low_groups(min_count: int, top_keep: int, max_share: float = 0.6, floor: int = 1) -> str:
    """``grouped``: rows of ``named`` with ``final``; ``pick``: the threshold used."""
    return f"""
cells AS (
  SELECT category, issue, subu, count(*) AS cnt FROM named
  WHERE category IS NOT NULL AND issue IS NOT NULL GROUP BY 1, 2, 3
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY category, issue ORDER BY cnt DESC, subu) AS rk FROM cells
),
pick AS (
  SELECT first_rows / greatest(1, total) > {max_share} AND {min_count} > {floor} AS relaxed,
         total, first_rows, floor_rows
  FROM (
    SELECT coalesce(sum(cnt) FILTER (rk > {top_keep} AND cnt < {min_count}), 0) AS first_rows,
           coalesce(sum(cnt) FILTER (rk > {top_keep} AND cnt < {floor}), 0) AS floor_rows
    FROM ranked), (SELECT count(*) AS total FROM named)
),
grouped AS (
  SELECT n.*, CASE WHEN r.rk > {top_keep}
                    AND r.cnt < CASE WHEN p.relaxed THEN {floor} ELSE {min_count} END
                   THEN 'others' ELSE n.subu END AS final
  FROM named n CROSS JOIN pick p
  LEFT JOIN ranked r ON n.category = r.category AND n.issue = r.issue AND n.subu = r.subu
)"""


def splits(source: str, val: float = 0.05, test: float = 0.05, seed: int = 42) -> str:
    """``split``: (row_id, grp, cls, split) of ``source`` (row_id, grp, cls)."""
    hold = val + test
    return f"""
sizes AS (SELECT grp, cls, count(*) AS n FROM {source} WHERE cls IS NOT NULL GROUP BY 1, 2),
pools AS (
  SELECT *, sum(n) OVER g AS total, coalesce(sum(CASE WHEN n > 1 THEN n END) OVER g, 0) AS pool
  FROM sizes WINDOW g AS (PARTITION BY grp)
),
draws AS (
  SELECT *, CAST(greatest(0, pool - ceil(CAST({hold!r} AS DOUBLE) * total)) AS HUGEINT) AS take FROM pools
),
shares AS (
  SELECT *, CASE WHEN n > 1 THEN (n::HUGEINT * take) // pool END AS base,
         CASE WHEN n > 1 THEN (n::HUGEINT * take) % pool END AS rest
  FROM draws
),
quotas AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rest DESC NULLS LAST, cls) AS rk,
         take - sum(base) OVER (PARTITION BY grp) AS short
  FROM shares
),
holds AS (
  SELECT grp, cls, CASE WHEN n = 1 THEN 0 ELSE n - base - CASE WHEN rk <= short THEN 1 ELSE 0 END END AS hold_n
  FROM quotas
),
in_class AS (
  SELECT s.row_id, s.grp, s.cls, h.hold_n,
         sum(h.hold_n) OVER (PARTITION BY s.grp, s.cls) / count(*) OVER (PARTITION BY s.grp, s.cls) AS same,
         row_number() OVER (PARTITION BY s.grp, s.cls ORDER BY md5('{seed}|' || s.row_id), s.row_id) AS rk
  FROM {source} s JOIN holds h ON s.cls = h.cls AND s.grp = h.grp
),
held AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('{seed}-test|' || row_id), row_id) AS trk,
         count(*) OVER (PARTITION BY grp) AS hold_all
  FROM in_class WHERE rk <= hold_n
),
split AS (
  SELECT row_id, grp, cls, 'train' AS split FROM in_class WHERE rk > hold_n
  UNION ALL
  SELECT row_id, grp, cls,
         CASE WHEN hold_all < 2 OR {val <= 0 or test <= 0} THEN 'both'
              WHEN trk <= ceil(CAST({test / hold!r} AS DOUBLE) * hold_all) THEN 'test' ELSE 'val' END
  FROM held
)"""


def row_block(row_id: str, updates: int) -> str:
    return f"('0x' || substring(md5({row_id}::VARCHAR), 1, 8))::BIGINT % {updates}"


def fit(prefix: str, epochs: int, lr: float, wd: float = 1e-4, dim: int = 64, updates: int = 1) -> str:
    """AdamW from zero, ``updates`` steps a pass on fixed blocks of rows, on ``{prefix}_tr`` (row_id, grp, y), ``{prefix}_k`` (grp, c)
    and ``xb`` (row_id, d, v, with the constant as dimension dim + 1);
    the last table is ``{prefix}_w{epochs * updates}`` (grp, c, d, w)."""
    p = prefix
    parts = [
        *(
            f"{p}_b{u} AS MATERIALIZED (SELECT * FROM {p}_tr WHERE {row_block('row_id', updates)} = {u})"
            for u in range(updates)
        ),
        *(f"{p}_n{u} AS (SELECT grp, count(*) AS n FROM {p}_b{u} GROUP BY 1)" for u in range(updates)),
        f"""{p}_w0 AS MATERIALIZED (
  SELECT grp, c, d, 0::DOUBLE AS w, 0::DOUBLE AS m, 0::DOUBLE AS s
  FROM {p}_k CROSS JOIN (SELECT unnest(generate_series(1, {dim + 1})) AS d))""",
    ]
    for e in range(epochs * updates):
        u = e % updates
        rate = 0.5 * lr * (1 + math.cos(math.pi * e / max(1, epochs * updates)))
        m_fix, s_fix = 1 - 0.9 ** (e + 1), 1 - 0.999 ** (e + 1)
        parts.append(f"""{p}_z{e} AS MATERIALIZED (
  SELECT t.row_id, t.grp, t.y, w.c, sum(w.w * x.v) AS z
  FROM {p}_b{u} t JOIN xb x ON t.row_id = x.row_id JOIN {p}_w{e} w ON w.grp = t.grp AND w.d = x.d
  GROUP BY ALL)""")
        parts.append(f"""{p}_p{e} AS MATERIALIZED (
  SELECT row_id, grp, y, c, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY row_id, grp) AS p
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id, grp) AS top FROM {p}_z{e}))""")
        parts.append(f"""{p}_g{e} AS MATERIALIZED (
  SELECT q.grp, q.c, x.d, sum((q.p - CASE WHEN q.c = q.y THEN 1 ELSE 0 END) * x.v) / any_value(n.n) AS g
  FROM {p}_p{e} q JOIN xb x ON q.row_id = x.row_id JOIN {p}_n{u} n ON n.grp = q.grp
  GROUP BY 1, 2, 3)""")
        parts.append(f"""{p}_w{e + 1} AS MATERIALIZED (
  SELECT grp, c, d,
         CASE WHEN n IS NULL THEN w
              ELSE w * {1 - rate * wd!r}::DOUBLE - {rate!r}::DOUBLE * (m / {m_fix!r}::DOUBLE)
                / (sqrt(s / {s_fix!r}::DOUBLE) + 1e-8) END AS w, m, s
  FROM (
    SELECT w.grp, w.c, w.d, w.w, n.n,
           CASE WHEN n.n IS NULL THEN w.m ELSE 0.9::DOUBLE * w.m + 0.1::DOUBLE * coalesce(g.g, 0) END AS m,
           CASE WHEN n.n IS NULL THEN w.s
                ELSE 0.999::DOUBLE * w.s + 0.001::DOUBLE * coalesce(g.g, 0) * coalesce(g.g, 0) END AS s
    FROM {p}_w{e} w LEFT JOIN {p}_n{u} n ON w.grp = n.grp
    LEFT JOIN {p}_g{e} g ON w.grp = g.grp AND w.c = g.c AND w.d = g.d))""")
    return ",\n".join(parts)


def held_ranks(prefix: str, weights: str, where: str) -> str:
    """``{prefix}_rk``: rank of the true class of held rows ``where``
    (row_id, grp, y, split) under ``weights`` (grp, c, d, w)."""
    return f"""
{prefix}_hz AS (
  SELECT h.row_id, h.grp, h.y, h.split, w.c, sum(w.w * x.v) AS z
  FROM {where} h JOIN xb x ON h.row_id = x.row_id JOIN {weights} w ON w.grp = h.grp AND w.d = x.d
  GROUP BY ALL
),
{prefix}_rk AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, grp ORDER BY z DESC, c) AS rk FROM {prefix}_hz)
  WHERE c = y
)"""


def four_rates(rank: str = "rk") -> str:
    out = []
    for split in ("val", "test"):
        for k in (1, 3):
            here = f"split IN ('{split}', 'both')"
            out.append(
                f"count(*) FILTER ({here} AND {rank} <= {k}) / greatest(1, count(*) FILTER ({here}))"
                f" AS {split}_top{k}_acc"
            )
    return ",\n  ".join(out)


CENTROIDS = """
cen AS (SELECT label AS c, d, avg(v) AS w FROM xl GROUP BY 1, 2),
bias AS (SELECT c, -0.5 * sum(w * w) AS b FROM cen GROUP BY 1),
z AS (
  SELECT x.row_id, any_value(x.label) AS label, w.c, sum(w.w * x.v) + any_value(b.b) AS z
  FROM xl x JOIN cen w USING (d) JOIN bias b ON b.c = w.c GROUP BY x.row_id, w.c
),
pr AS (
  SELECT row_id, label, c, z, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY row_id) AS p
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id) AS top FROM z)
),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, c) AS rk FROM pr)"""

# router over categories, heads over the labels of a category
TWO_LEVELS = """
rcen AS (SELECT category AS c, d, avg(v) AS w FROM xl GROUP BY 1, 2),
rbias AS (SELECT c, -0.5 * sum(w * w) AS b FROM rcen GROUP BY 1),
rz AS (
  SELECT x.row_id, w.c, sum(w.w * x.v) + any_value(b.b) AS z
  FROM xl x JOIN rcen w USING (d) JOIN rbias b ON b.c = w.c GROUP BY 1, 2
),
rp AS (
  SELECT row_id, c, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY row_id) AS p
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id) AS top FROM rz)
),
rr AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, c) AS rk FROM rp),
hcen AS (SELECT category AS grp, label AS c, d, avg(v) AS w FROM xl GROUP BY 1, 2, 3),
hbias AS (SELECT grp, c, -0.5 * sum(w * w) AS b FROM hcen GROUP BY 1, 2),
hz AS (
  SELECT x.row_id, w.grp, w.c, sum(w.w * x.v) + any_value(b.b) AS z
  FROM xl x JOIN hcen w USING (d) JOIN hbias b ON b.c = w.c GROUP BY 1, 2, 3
),
hp AS (
  SELECT row_id, grp, c, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY row_id, grp) AS p
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id, grp) AS top FROM hz)
),
hr AS (SELECT *, row_number() OVER (PARTITION BY row_id, grp ORDER BY p DESC, c) AS rk FROM hp)"""

XB = """
xb AS MATERIALIZED (
  SELECT row_id, d, v FROM xl UNION ALL SELECT row_id, 65, 1::DOUBLE FROM vec
)"""

TRAINED = f"""
WITH {VECTORS}, {XB},
named AS (
  SELECT row_id, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS cat_idx,
         CAST(dense_rank() OVER (PARTITION BY category ORDER BY label) - 1 AS INT) AS head_idx
  FROM vec
),
roles AS (
  SELECT row_id, -1 AS grp, cat_idx AS cls FROM named
  UNION ALL SELECT row_id, cat_idx, head_idx FROM named
),
{splits("roles")}"""


def trained(which: str, epochs: int, lr: float) -> str:
    """Training and held-out accuracy of the router or of all heads."""
    mine = "grp = -1" if which == "router" else "grp >= 0"
    return f"""{TRAINED},
f_tr AS MATERIALIZED (SELECT row_id, grp, cls AS y FROM split WHERE split = 'train' AND {mine}),
f_k AS (SELECT DISTINCT grp, cls AS c FROM roles WHERE {mine}),
f_held AS MATERIALIZED (SELECT row_id, grp, cls AS y, split FROM split WHERE split <> 'train' AND {mine}),
{fit("f", epochs, lr)},
{held_ranks("f", f"f_w{epochs}", "f_held")}"""


def tuned(n_trials: int, rung: int, default: tuple[float, int], epochs_range: tuple[int, int], seed: int = 42) -> str:
    """Validation top-1 of router trials, parameters by hash of the trial number; the better
    half after ``rung`` passes and trial 0, the default, go on."""
    parts, full, early = [], [], []
    low, high = epochs_range
    for t in range(n_trials):
        u = {
            name: int(hashlib.md5(f"{seed}|{t}|{name}".encode()).hexdigest()[:8], 16) / 2**32
            for name in ("router_lr", "router_epochs")
        }
        lr = math.exp(math.log(5e-3) + u["router_lr"] * (math.log(0.5) - math.log(5e-3)))
        epochs = low + math.floor(u["router_epochs"] * (high - low + 1))
        if t == 0:
            lr, epochs = default
        parts.append(f"t{t}_tr AS (SELECT * FROM f_tr), t{t}_k AS (SELECT * FROM f_k)")
        parts.append(fit(f"t{t}", epochs, lr))
        for name, at, picks in ((f"t{t}", epochs, full), (f"t{t}e", min(epochs, rung), early)):
            parts.append(held_ranks(name, f"t{t}_w{at}", "f_val"))
            picks.append(
                f"SELECT CAST({t} AS INT) AS trial, CAST({epochs} AS INT) AS router_epochs,"
                f" avg(CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END) AS score FROM {name}_rk"
            )
    return f"""{TRAINED},
f_tr AS MATERIALIZED (SELECT row_id, grp, cls AS y FROM split WHERE split = 'train' AND grp = -1),
f_k AS (SELECT DISTINCT grp, cls AS c FROM roles WHERE grp = -1),
f_val AS MATERIALIZED (
  SELECT row_id, grp, cls AS y, split FROM split WHERE split IN ('val', 'both') AND grp = -1),
{", ".join(parts)},
last AS ({" UNION ALL ".join(full)}),
early AS (SELECT *, row_number() OVER (ORDER BY score DESC, trial) AS place FROM ({" UNION ALL ".join(early)}))
SELECT trial, last.router_epochs,
  round(CASE WHEN place <= {math.ceil(0.5 * n_trials)} OR trial = 0 THEN last.score ELSE early.score END, 6) AS score,
  place <= {math.ceil(0.5 * n_trials)} OR trial = 0 AS finished
FROM last JOIN early USING (trial)"""


def whole_job(epochs: int, updates: int, lr: float = 0.05, slots: int = 1024) -> str:
    """The training job on documents: tokens to vectors, splits, router and heads, held-out accuracy."""
    return f"""
WITH texts AS MATERIALIZED (
  SELECT * FROM (
    SELECT doc_id AS row_id, {clean("text")} AS c, lang || '__SEP__' || lang AS label,
           'grp' || CAST(CAST(replace(source, 'src', '') AS INT) % 4 AS VARCHAR) AS category
    FROM documents)
  WHERE trim(c) <> ''),
{vectors_of("texts", slots)},
xb AS MATERIALIZED (
  SELECT row_id, slot + 1 AS d, v FROM entries UNION ALL SELECT row_id, {slots + 1}, 1::DOUBLE FROM texts),
named AS MATERIALIZED (
  SELECT row_id, category, label, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS cat_idx,
         count(*) OVER (PARTITION BY category, label) AS n
  FROM texts),
roles AS (
  SELECT row_id, -1 AS grp, cat_idx AS cls FROM named
  UNION ALL
  SELECT row_id, cat_idx, CAST(dense_rank() OVER (PARTITION BY cat_idx ORDER BY label) - 1 AS INT)
  FROM named WHERE n >= 2),
{splits("roles")},
f_tr AS MATERIALIZED (SELECT row_id, grp, cls AS y FROM split WHERE split = 'train'),
f_k AS (SELECT DISTINCT grp, cls AS c FROM roles),
f_held AS MATERIALIZED (SELECT row_id, grp, cls AS y, split FROM split WHERE split <> 'train'),
{fit("f", epochs, lr, dim=slots, updates=updates)},
{held_ranks("f", f"f_w{epochs * updates}", "f_held")},
rates AS (SELECT grp, {four_rates()} FROM f_rk GROUP BY 1)
SELECT 'docs' AS model_id, n.category, r.val_top1_acc, r.val_top3_acc, r.test_top1_acc, r.test_top3_acc, '' AS note
FROM rates r LEFT JOIN (SELECT DISTINCT category, cat_idx FROM named) n ON r.grp = n.cat_idx"""


def vectors_of(texts: str, slots: int) -> str:
    """``entries`` (row_id, slot, v) of cleaned texts (row_id, c): unit TF-IDF as float32."""
    return f"""
tokens AS (SELECT row_id, unnest(list_filter(string_split(c, ' '), lambda w: w <> '')) AS w FROM {texts}),
counts AS MATERIALIZED (
  SELECT row_id, ('0x' || substring(md5(w), 1, 8))::BIGINT % {slots} AS slot, count(*) AS n FROM tokens GROUP BY 1, 2),
idf AS (
  SELECT slot, ln(((SELECT count(*) FROM {texts}) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM counts GROUP BY 1),
scaled AS MATERIALIZED (
  SELECT * FROM (SELECT row_id, slot, n * idf AS v FROM counts JOIN idf USING (slot)) WHERE v <> 0),
entries AS MATERIALIZED (
  SELECT row_id, slot, CAST(CAST(v / norm AS FLOAT) AS DOUBLE) AS v
  FROM scaled JOIN (SELECT row_id, sqrt(sum(v * v)) AS norm FROM scaled GROUP BY 1) USING (row_id))"""


def request_fixture() -> str:
    return """
turns AS (
  SELECT conv_id, turn, role, to_json({'text': text})::VARCHAR AS js, substring(js, 2) AS body,
         (conv_id * 7 + turn * 3) % 20 AS kind
  FROM conversations
),
req AS (
  SELECT conv_id * 1000 + turn AS req_id,
    CASE kind
      WHEN 0 THEN 'not a json ' || role
      WHEN 1 THEN '[' || js || ']'
      WHEN 2 THEN '{"role":"' || role || '"}'
      WHEN 3 THEN '{"text":"  "}'
      WHEN 4 THEN '{"text":' || turn || '}'
      WHEN 5 THEN '{"art_dir":"no_such_model",' || body
      WHEN 6 THEN '{"topk_cat":"zz",' || body
      WHEN 7 THEN '{"topk_sub":null,' || body
      WHEN 8 THEN '{"topk_cat":"7",' || body
      WHEN 9 THEN '{"topk_cat":2.7,"topk_sub":true,' || body
      WHEN 10 THEN '{"topk_cat":-3,"art_dir":"",' || body
      WHEN 11 THEN '{"text":"123"}'
      -- numbers that this engine's JSON cannot hold stand as strings
      WHEN 12 THEN '{"topk_cat":"99999999999999999999",' || body
      WHEN 13 THEN '{"topk_sub":"-99999999999999999999",' || body
      WHEN 14 THEN '{"topk_cat":"inf",' || body
      WHEN 15 THEN '{"topk_sub":"nan",' || body
      ELSE '{"topk_cat":' || (1 + turn % 3) || ',"topk_sub":' || (1 + turn % 5) || ',' || body
    END AS value
  FROM turns
)"""


def _int(name: str, default: int) -> str:
    kind, text = f"json_type(js, '$.{name}')", f"json_extract_string(js, '$.{name}')"
    return f"""CASE WHEN {kind} IS NULL THEN {default}
         WHEN regexp_full_match({text}, '[+-]?[0-9]+') THEN TRY_CAST({text} AS HUGEINT)
         WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN TRY_CAST(trunc(TRY_CAST({text} AS DOUBLE)) AS HUGEINT)
         WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1 ELSE 0 END END"""


def _int_error(name: str) -> str:
    kind, text = f"json_type(js, '$.{name}')", f"json_extract_string(js, '$.{name}')"
    return f"""CASE {kind}
         WHEN 'NULL' THEN 'int() argument must be a string, a bytes-like object or a real number, not ''NoneType'''
         WHEN 'VARCHAR' THEN CASE WHEN {text} = 'nan' THEN 'cannot convert float NaN to integer'
           WHEN {text} = 'inf' THEN 'cannot convert float infinity to integer'
           WHEN NOT regexp_full_match({text}, '\\s*[+-]?[0-9]+\\s*')
           THEN 'invalid literal for int() with base 10: ''' || {text} || '''' END END"""


def validate() -> str:
    return f"""
WITH {request_fixture()},
parsed AS (SELECT req_id, CASE WHEN json_valid(value) THEN value::JSON END AS js FROM req),
typed AS (
  SELECT req_id,
    CASE WHEN js IS NULL THEN 'Invalid or missing JSON'
         WHEN json_type(js) <> 'OBJECT' THEN 'JSON body must be an object'
         WHEN coalesce(json_type(js, '$.text'), '') <> 'VARCHAR'
           OR trim(json_extract_string(js, '$.text')) = '' THEN 'Field ''text'' must be a non-empty string'
    END AS bad,
    coalesce({_int_error("topk_cat")}, {_int_error("topk_sub")}) AS not_int,
    json_extract_string(js, '$.text') AS text,
    coalesce(nullif(json_extract_string(js, '$.art_dir'), ''), 'default') AS model_id,
    greatest(1, {_int("topk_cat", 2)}) AS topk_cat,
    {_int("topk_sub", 5)} AS topk_sub
  FROM parsed
),
judged AS (
  SELECT *, CASE WHEN bad IS NOT NULL THEN 400 WHEN not_int IS NOT NULL THEN 500
                 WHEN model_id <> 'default' THEN 404 ELSE 200 END AS status
  FROM typed
)
SELECT req_id, CAST(status AS INT) AS status,
  CASE status WHEN 400 THEN bad WHEN 500 THEN not_int
              WHEN 404 THEN 'Artifacts directory not found: ' || model_id END AS error,
  CASE WHEN status = 200 THEN text END AS text,
  CASE WHEN status = 200 THEN model_id END AS model_id,
  CASE WHEN status = 200 THEN CAST(topk_cat AS VARCHAR) END AS topk_cat,
  CASE WHEN status = 200 THEN CAST(topk_sub AS VARCHAR) END AS topk_sub
FROM judged"""


# trial parameters and the score of a centroid model whose bias they scale
TRIALS = f"""
WITH {VECTORS},
par AS (
  SELECT trial,
    CASE WHEN trial = 0 THEN 0.05::DOUBLE ELSE exp(ln(5e-3) + ('0x' || substring(md5('42|' || trial || '|router_lr'), 1, 8))::BIGINT / 4294967296::DOUBLE
        * (ln(0.5) - ln(5e-3))) END AS router_lr,
    CASE WHEN trial = 0 THEN CAST(60 AS INT) ELSE CAST(10 + floor(('0x' || substring(md5('42|' || trial || '|router_epochs'), 1, 8))::BIGINT
        / 4294967296::DOUBLE * 71) AS INT) END AS router_epochs
  FROM (SELECT CAST(unnest(generate_series(0, 11)) AS INT) AS trial)
),
rcen AS (SELECT category AS c, d, avg(v) AS w FROM xl GROUP BY 1, 2),
rbias AS (SELECT c, -0.5 * sum(w * w) AS b FROM rcen GROUP BY 1),
dot AS (
  SELECT x.row_id, any_value(x.category) AS y, w.c, sum(w.w * x.v) AS z
  FROM xl x JOIN rcen w USING (d) GROUP BY x.row_id, w.c
),
best AS (
  SELECT p.trial, d.row_id, d.y, arg_max(d.c, d.z + b.b * p.router_lr * 200) AS c
  FROM dot d JOIN rbias b USING (c) CROSS JOIN par p GROUP BY 1, 2, 3
),
scored AS (
  SELECT p.trial, round(p.router_lr, 12) AS router_lr, p.router_epochs,
         round(avg(CASE WHEN b.c = b.y THEN 1.0 ELSE 0.0 END), 6) AS score
  FROM par p JOIN best b USING (trial) GROUP BY ALL
)"""


def sql() -> dict[str, str]:
    counted = "SELECT category, issue, final AS subissue_unique, count(*) AS n_rows FROM grouped GROUP BY 1, 2, 3"
    items = f"WITH {ITEMS},{unique_names('items')}"
    labelled = f"""{DOCS},
lab AS (SELECT row_id, coalesce(category, 'nan') AS category,
               coalesce(issue, 'nan') || '__SEP__' || coalesce(subissue, 'nan') AS label FROM tickets)"""
    fine = f"""{DOCS},
lab AS (SELECT category || '/' || issue || '/' || subissue AS category, grade AS label FROM tickets),
cnt AS (SELECT category, label, count(*) AS cnt FROM lab GROUP BY 1, 2)"""
    predicted = f"""WITH {VECTORS},{TWO_LEVELS}
SELECT r.row_id, CAST(r.rk AS INT) AS cat_rank, 'c' || r.c AS category, round(r.p, 6) AS cat_proba,
  CAST(h.rk AS INT) AS sub_rank, 'i' || (h.c % 2) || '__SEP__l' || h.c AS label,
  'i' || (h.c % 2) AS issue, 'l' || h.c AS subissue_unique, round(h.p, 6) AS sub_proba
FROM rr r LEFT JOIN hr h ON h.row_id = r.row_id AND h.grp = r.c AND r.c <> 4
WHERE r.rk <= 2"""
    return {
        "clean_text": f"SELECT doc_id AS row_id, {clean('text')} AS text_clean FROM documents",
        "grade_filter": f"""WITH {DOCS}
SELECT row_id, grade FROM tickets WHERE TRY_CAST(grade AS DOUBLE) IN (4, 5)""",
        "drop_empty_texts": f"""
WITH t AS (SELECT page_id AS row_id, {clean("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS text_obr FROM pages
  UNION ALL SELECT -1 - (conv_id * 1000 + turn), {clean("text")} FROM conversations)
SELECT row_id, text_obr FROM t WHERE trim(text_obr) <> ''""",
        "safe_key": f"""
WITH n AS (SELECT p_partkey, p_type || '  ' || p_name || ' / ' || p_brand || ' ' AS name FROM part)
SELECT p_partkey, name, {safe_key('name')} AS dir_name FROM n""",
        "compose_label": f"WITH {labelled} SELECT row_id, label FROM lab",
        "decompose_label": f"""WITH {labelled},
odd AS (SELECT row_id, CASE row_id % 4 WHEN 0 THEN '__single__' WHEN 1 THEN replace(label, '__SEP__', '-')
                            WHEN 2 THEN label || '__SEP__x' ELSE label END AS label FROM lab)
SELECT row_id, label,
  CASE WHEN contains(label, '__SEP__') THEN substring(label, 1, strpos(label, '__SEP__') - 1) END AS issue,
  CASE WHEN label = '__single__' THEN NULL
       WHEN contains(label, '__SEP__') THEN substring(label, strpos(label, '__SEP__') + 7)
       ELSE label END AS subissue_unique
FROM odd""",
        "stage_counts": f"""WITH {DOCS},
f AS (SELECT TRY_CAST(grade AS DOUBLE) IN (4, 5) AS good, trim({clean('text_obr')}) <> '' AS filled FROM tickets),
c AS (SELECT count(*) AS n0, count(*) FILTER (good) AS n1, count(*) FILTER (good AND filled) AS n2 FROM f)
SELECT CAST(0 AS INT) AS step, 'loaded' AS stage, n0 AS n_rows FROM c
UNION ALL SELECT 1, 'graded', n1 FROM c UNION ALL SELECT 2, 'filled', n2 FROM c
UNION ALL SELECT 3, 'sampled', least(n2, 200) FROM c""",
        "load_table": f"""WITH {DOCS}
SELECT row_id::VARCHAR AS row_id, text_obr, category, issue, subissue, nullif(grade, 'n/a') AS grade FROM tickets""",
        "ambiguous_labels": f"""WITH {ITEMS}
SELECT subissue, count(DISTINCT issue) AS n_issues FROM items GROUP BY 1 HAVING count(DISTINCT issue) > 1""",
        "label_counts": f"""WITH {ITEMS}
SELECT category, issue, subissue, count(*) AS cnt FROM items
WHERE category IS NOT NULL AND issue IS NOT NULL GROUP BY 1, 2, 3""",
        "disambiguate_labels": f"""{items}
SELECT category, issue, subu AS subissue_unique, count(*) AS n_rows FROM named GROUP BY 1, 2, 3""",
        "top_keep_labels": f"""{items},{low_groups(30, 5)}
SELECT category, issue, subu AS subissue_unique, cnt, CAST(rk AS INT) AS rank FROM ranked WHERE rk <= 5""",
        "group_lowfreq": f"{items},{low_groups(30, 5)} {counted}",
        "group_lowfreq_relaxed": f"{items},{low_groups(50, 2)} {counted}",
        "curate": f"{items},{low_groups(30, 5)} {counted}",
        "curation_report": f"""{items},{low_groups(30, 5)}
SELECT (SELECT count(*) FROM amb) AS duplicates_detected,
  (SELECT count(*) FROM named WHERE amb) AS rows_appended_suffix,
  CAST(30 AS INT) AS min_count, CAST(5 AS INT) AS top_keep_per_issue,
  CAST(CASE WHEN relaxed THEN floor_rows ELSE first_rows END AS BIGINT) AS final_others_rows,
  round(CASE WHEN relaxed THEN floor_rows ELSE first_rows END / greatest(1, total), 6) AS final_others_share,
  CASE WHEN relaxed THEN 'auto-relaxed threshold 30->1, share='
    || printf('%.4f', floor_rows / greatest(1, total)) ELSE '' END AS note
FROM pick""",
        "head_label_counts": f"WITH {labelled} SELECT category, label, count(*) AS cnt FROM lab GROUP BY 1, 2",
        "head_training_rows": f"""WITH {labelled}
SELECT row_id, category, label FROM
  (SELECT *, count(*) OVER (PARTITION BY category, label) AS n FROM lab) WHERE n >= 2""",
        "head_plan": f"""WITH {fine},
p AS (SELECT category, CAST(sum(cnt) AS BIGINT) AS n_rows, count(*) FILTER (cnt >= 2) AS n_labels,
        CAST(coalesce(sum(cnt) FILTER (cnt >= 2), 0) AS BIGINT) AS train_rows,
        max(label) FILTER (cnt >= 2) AS one FROM cnt GROUP BY 1)
SELECT category, n_rows, n_labels, train_rows,
  CASE WHEN n_rows < 2 THEN 'none' WHEN n_labels < 2 THEN 'single' ELSE 'trained' END AS kind,
  CASE WHEN n_rows >= 2 AND n_labels = 1 THEN one END AS only_label
FROM p""",
        "model_manifest": f"""WITH {fine}
SELECT 'manifest' AS model_id, category, sum(cnt) >= 2 AS head_saved,
  CASE WHEN sum(cnt) >= 2 THEN {safe_key('category')} END AS dir_name
FROM cnt GROUP BY category""",
        "encode_labels": f"""WITH {labelled},
big AS (SELECT category, label, row_number() OVER (PARTITION BY category ORDER BY label) - 1 AS idx
        FROM lab GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT row_id, CAST(dense_rank() OVER (ORDER BY lab.category) - 1 AS INT) AS cat_idx, CAST(idx AS INT) AS head_idx
FROM lab LEFT JOIN big ON lab.category = big.category AND lab.label = big.label""",
        "decode_labels": f"WITH {labelled} SELECT row_id, category FROM lab",
        "stratified_split": f"""WITH {DOCS},
src AS (SELECT row_id, 0 AS grp, category AS cls FROM tickets),{splits('src')}
SELECT row_id, cls AS category, split FROM split""",
        "val_test_split": f"""WITH {labelled},
src AS (SELECT row_id, category AS grp, label AS cls FROM lab),{splits('src')},
two AS (SELECT * EXCLUDE (split), unnest(CASE WHEN split = 'both' THEN ['val', 'test'] ELSE [split] END) AS split
        FROM split)
SELECT row_id, grp AS category, cls AS label, split FROM two""",
        "sample_rows": f"""WITH {DOCS}
SELECT row_id FROM tickets ORDER BY md5('42|' || row_id), row_id LIMIT 500""",
        "embed_texts": f"""
WITH texts AS MATERIALIZED (SELECT doc_id AS row_id, {clean('text')} AS c FROM documents),
{vectors_of("texts", 1024)}
SELECT row_id, CAST(slot AS INT) AS slot, round(v, 5) AS value FROM entries WHERE v <> 0""",
        "fit_hierarchy": whole_job(4, 4),
        "linear_scores": f"""WITH {VECTORS},{CENTROIDS}
SELECT row_id, CAST(c AS INT) AS class_idx, round(z, 6) AS score FROM z""",
        "softmax_proba": f"""WITH {VECTORS},{CENTROIDS}
SELECT row_id, CAST(c AS INT) AS class_idx, round(p, 6) AS proba FROM pr""",
        "topk_classes": f"""WITH {VECTORS},{CENTROIDS}
SELECT row_id, CAST(rk AS INT) AS rank, CAST(c AS INT) AS class_idx, round(p, 6) AS proba FROM rk WHERE rk <= 3""",
        "topk_accuracy": f"""WITH {VECTORS},{CENTROIDS}
SELECT count(*) AS n_rows, round(avg(CASE WHEN rk <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1_acc,
  round(avg(CASE WHEN rk <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3_acc
FROM rk WHERE c = label""",
        "head_stats": f"""{TRAINED}, {XB.replace("xb AS", "xd AS")},
h_tr AS (SELECT row_id, grp, cls AS y FROM split WHERE split = 'train'),
h_held AS (SELECT row_id, grp, cls AS y, split FROM split WHERE split <> 'train'),
h_c AS (SELECT t.grp, t.y AS c, x.d, avg(x.v) AS w FROM h_tr t JOIN xl x USING (row_id) GROUP BY 1, 2, 3),
h_w AS (SELECT * FROM h_c UNION ALL SELECT grp, c, 65, -0.5 * sum(w * w) FROM h_c GROUP BY 1, 2),
{held_ranks("h", "h_w", "h_held")}
SELECT CAST(grp AS INT) AS model, {four_rates()} FROM h_rk GROUP BY 1""",
        "hier_predict": predicted,
        "hier_predict_blocks": predicted,
        "softmax_gradient_step": f"""WITH {VECTORS},
n AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM vec),
k AS (SELECT DISTINCT label AS c FROM vec)
SELECT CAST(c AS INT) AS class_idx, CAST(d - 1 AS INT) AS dim,
  round(sum((1.0::DOUBLE / n.k - CASE WHEN xl.label = c THEN 1 ELSE 0 END) * v) / any_value(n.n), 9) AS grad
FROM xl CROSS JOIN k CROSS JOIN n GROUP BY c, d""",
        "softmax_fit": f"""WITH {VECTORS}, {XB},
r_tr AS (SELECT row_id, -1 AS grp, category AS y FROM vec
  UNION ALL SELECT row_id, category, label % 2 FROM vec),
r_k AS (SELECT DISTINCT grp, y AS c FROM r_tr),
{fit("r", 3, 0.05)}
SELECT CAST(grp AS INT) AS model, CAST(c AS INT) AS class_idx, CAST(d - 1 AS INT) AS dim, round(w, 6) AS weight
FROM r_w3""",
        "softmax_fit_blocks": f"""WITH {VECTORS}, {XB},
r_tr AS (SELECT row_id, -1 AS grp, category AS y FROM vec),
r_k AS (SELECT DISTINCT grp, y AS c FROM r_tr),
{fit("r", 2, 0.05, updates=3)}
SELECT CAST(grp AS INT) AS model, CAST(c AS INT) AS class_idx, CAST(d - 1 AS INT) AS dim, round(w, 6) AS weight
FROM r_w6""",
        "train_router": f"""{trained("router", 5, 0.05)}
SELECT {four_rates()} FROM f_rk""",
        "train_heads": f"""{trained("heads", 4, 0.05)}
SELECT 'c' || grp AS category, {four_rates()} FROM f_rk GROUP BY 1""",
        "train_summary": f"""{trained("router", 3, 0.05)}
SELECT 'vectors' AS model_id,
  {four_rates().replace("_top1_acc", "_top1").replace("_top3_acc", "_top3").replace("AS ", "AS router_")},
  (SELECT string_agg('c' || category, '|' ORDER BY category) FROM (SELECT DISTINCT category FROM vec)) AS kept_categories,
  (SELECT string_agg('c' || category, '|' ORDER BY category) FROM (SELECT DISTINCT category FROM vec)) AS heads_saved
FROM f_rk""",
        "tune_router": tuned(5, 2, (0.05, 4), (2, 6)),
        "score_requests": f"""
WITH v AS ({validate()}),
k AS (SELECT count(DISTINCT CAST(replace(source, 'src', '') AS INT) % 4) AS n FROM documents)
SELECT req_id, status, error,
  CASE WHEN status = 200 THEN CAST(least(CAST(topk_cat AS HUGEINT), k.n) AS INT) END AS n_categories,
  CASE WHEN status = 200 THEN TRUE END AS best_first
FROM v CROSS JOIN k""",
        "trial_table": f"{TRIALS} SELECT * FROM scored",
        "best_trial": f"{TRIALS} SELECT * FROM scored ORDER BY score DESC, trial LIMIT 1",
        "validate_requests": validate(),
    }
