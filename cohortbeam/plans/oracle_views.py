"""The fixture views of ``cohortbeam.fixtures`` written as DuckDB SQL.

Oracle SQL for a query is ``views(...)`` + its SELECT; the views are
independent re-statements of the fixture definitions, so the oracle checks
the Spark plans, not a copy of them.
"""
from __future__ import annotations

from ..constants import LABELS


def _w(i: str, k: str) -> str:
    return f"(CAST((({i})*7 + ({k})*5) % 13 - 6 AS DOUBLE) / 10.0)"


def linear_sql(k: str, emb: str = "e.embedding", meta: list[str] | None = None) -> str:
    """sigmoid(sum_i x_i * w(i, k)) over the embedding (i = 1..64) followed by
    optional float32 metadata features (i = 65..)."""
    z = f"list_sum(list_transform({emb}, lambda v, i: CAST(v AS DOUBLE) * {_w('i', k)}))"
    for j, m in enumerate(meta or []):
        z += f" + CAST(CAST({m} AS FLOAT) AS DOUBLE) * {_w(str(65 + j), k)}"
    return f"(1.0 / (1.0 + exp(-({z}))))"


_label_cols = ",\n  ".join(
    f"CAST((event_id + {k}) % {k + 11} = 0 AS INTEGER) AS {name}" for k, name in enumerate(LABELS))
_label_any = " + ".join(f"CAST((event_id + {k}) % {k + 11} = 0 AS INTEGER)" for k in range(len(LABELS)))
_labels_list = ", ".join(f"'{x}'" for x in LABELS)


def _image_path(prefix: str) -> str:
    return (f"'{prefix}images_' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 3, '0') || '/images/' || "
            f"lpad(CAST(event_id AS VARCHAR), 8, '0') || '.png'")


VIEWS: dict[str, tuple[list[str], str]] = {
    "studies": ([], """
SELECT event_id AS idx,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE user_id END AS patient_id,
  CASE WHEN event_id % 61 = 0 THEN 'abc'
       ELSE lpad(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 3, '0') || 'Y' END AS age_raw,
  CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender,
  CASE event_type WHEN 'view' THEN 'PA' WHEN 'click' THEN 'AP' WHEN 'purchase' THEN 'AP supine'
                  WHEN 'signup' THEN 'LL' END AS view_position,
  ts
FROM events"""),
    "label_matrix": ([], f"""
SELECT event_id AS idx,
  {_label_cols},
  CAST(({_label_any}) = 0 AS INTEGER) AS no_finding
FROM events"""),
    "bad_labels": ([], "SELECT event_id AS idx FROM events WHERE event_id % 97 = 0"),
    "paths": ([], f"SELECT event_id AS idx, {_image_path('')} AS file_path FROM events WHERE event_id % 101 <> 0"),
    "paths_alt": ([], f"SELECT event_id AS idx, {_image_path('alt/')} AS file_path FROM events WHERE event_id % 103 <> 0"),
    "uploads": ([], """
SELECT p_partkey AS idx,
  CASE WHEN p_partkey % 29 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS name,
  p_size * 4 - 20 AS age,
  CASE p_size % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'm' WHEN 3 THEN 'f' WHEN 4 THEN 'X' END AS gender,
  CASE p_type WHEN 'ECONOMY' THEN 'AP' WHEN 'LARGE' THEN 'PA' WHEN 'MEDIUM' THEN 'ap' WHEN 'PROMO' THEN 'pa'
              WHEN 'SMALL' THEN 'LL' WHEN 'STANDARD' THEN 'AP' END AS view,
  CASE WHEN p_partkey % 17 = 0 THEN encode(p_name)
       WHEN p_partkey % 3 = 0 THEN unhex('FFD8FFE0') || encode(p_name)
       ELSE unhex('89504E470D0A1A0A') || encode(p_name) END AS content
FROM part"""),
    "folders": ([], """
SELECT p_partkey AS idx,
  CASE WHEN p_partkey % 31 = 0 THEN 'run_' || CAST(p_partkey AS VARCHAR)
       ELSE coalesce(nullif(upper(left(regexp_replace(p_name, '[^a-zA-Z]', '', 'g'), 1))
                            || lower(substr(regexp_replace(p_name, '[^a-zA-Z]', '', 'g'), 2)), ''), 'Unknown')
            || strftime(DATE '2026-01-01' + CAST(p_partkey % 60 AS INTEGER), '%Y%m%d') END AS folder_name,
  DATE '2026-01-01' + CAST(p_partkey % 60 AS INTEGER) AS run_date,
  p_name AS patient_name, p_size, p_type
FROM part"""),
    "files": (["folders"], """
SELECT f.idx, f.folder_name, n.file_name
FROM folders f, (VALUES ('original.png', 7), ('gradcam_Mass.png', 5), ('metadata.json', 11),
                        ('predictions.json', 13)) AS n(file_name, m)
WHERE f.idx % n.m <> 0"""),
    "scores": ([], f"""
SELECT e.vec_id, k.k, {linear_sql('k.k')} AS score
FROM embeddings e, range(0, 14) AS k(k)"""),
    "truth": ([], """
SELECT vec_id, k.k, CAST(label = k.k AS INTEGER) AS truth FROM embeddings, range(0, 14) AS k(k)"""),
    "label_names": ([], f"""
SELECT CAST(i - 1 AS BIGINT) AS k, name FROM (SELECT unnest([{_labels_list}]) AS name,
       generate_subscripts([{_labels_list}], 1) AS i)"""),
    "scored": (["scores", "truth", "label_names"], """
SELECT s.vec_id AS image_key, n.name AS label, s.score, t.truth
FROM scores s JOIN truth t ON s.vec_id = t.vec_id AND s.k = t.k JOIN label_names n ON n.k = s.k"""),
    "tied_scored": (["scored"], "SELECT image_key, label, round(score, 1) AS score, truth FROM scored"),
    "tensors": ([], """
SELECT vec_id AS image_key, CAST((i - 1) // 4 AS INTEGER) AS cell, CAST((i - 1) % 4 AS INTEGER) AS ch,
       CAST(v AS DOUBLE) AS act, CAST(v AS DOUBLE) * CAST(v AS DOUBLE) - 0.01 AS grad
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"""),
    "groups": ([], """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS idx, CAST(conv_id AS VARCHAR) AS group_key, role
FROM conversations"""),
}


def views(*names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """WITH clause defining the named views (and their dependencies) in
    order, followed by extra (name, select) CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order]
    parts += [f"{n} AS ({body}\n)" for n, body in (ctes or [])]
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""


def sql(names: list[str], body: str, ctes: list[tuple[str, str]] | None = None) -> str:
    return views(*names, ctes=ctes) + body
