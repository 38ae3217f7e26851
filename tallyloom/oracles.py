"""DuckDB SQL of the catalogue's queries, put together from common table expressions."""

from __future__ import annotations

import re

_TOKENS = r"regexp_extract_all(replace(lower(nfc_normalize(coalesce({0}, ''))), 'ß', 'ss'), '[\p{{L}}\p{{N}}\p{{M}}]+')"
CONFIG_LIST = "['000', '001', '010', '011', '100', '101', '110', '111']"
_S = [f"s{i:03b}" for i in range(8)]

#: In order of use; each may use those before it.
CTES = {
    "tok": f"SELECT doc_id::VARCHAR AS item, unnest({_TOKENS.format('text')}) AS feature FROM documents",
    "post": "SELECT item, feature, count(*)::DOUBLE AS value FROM tok GROUP BY ALL",
    "items": """SELECT d.item, coalesce(l.length, 0)::DOUBLE AS length, coalesce(l.nnz, 0)::BIGINT AS nnz FROM (SELECT doc_id::VARCHAR AS item FROM documents) d
        LEFT JOIN (SELECT item, sum(value) AS length, count(*) AS nnz FROM post GROUP BY 1) l ON d.item = l.item""",
    "coll": """SELECT count(*)::BIGINT AS n_items, coalesce(sum(length), 0)::DOUBLE AS length_sum, coalesce(sum(nnz), 0)::BIGINT AS nnz_sum,
        coalesce(sum(length) / count(*), 0)::DOUBLE AS avg_length FROM items""",
    "fs": "SELECT feature, count(*)::BIGINT AS df, sum(value)::DOUBLE AS mass FROM post GROUP BY 1",
    "qt": f"SELECT DISTINCT item_id::VARCHAR AS query, unnest({_TOKENS.format('text')}) AS feature FROM benchmark",
    "w": """SELECT p.item, p.feature, p.value, ln(1 + (n_items - df + 0.5e0) / (df + 0.5e0)) AS idf,
        CASE WHEN avg_length > 0 THEN 0.25e0 + 0.75e0 * length / avg_length ELSE 1e0 END AS rel
        FROM post p JOIN fs USING (feature) JOIN items USING (item), coll""",
    "lw": """SELECT *, value AS v000, value / rel AS v001, 2.2e0 * value / (value + 1.2e0) AS v010, 2.2e0 * value / (value + 1.2e0 * rel) AS v011,
        idf * value AS v100, idf * value / rel AS v101, idf * 2.2e0 * value / (value + 1.2e0) AS v110, idf * 2.2e0 * value / (value + 1.2e0 * rel) AS v111 FROM w""",
    "sums": "SELECT query, item, " + ", ".join(f"sum(v{x[1:]}) AS {x}" for x in _S) + ", count(*)::BIGINT AS matched FROM qt JOIN lw USING (feature) GROUP BY 1, 2",
    "lat": f"SELECT query, item, unnest({CONFIG_LIST}) AS config, unnest([{', '.join(_S)}]) AS score FROM sums",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query, config ORDER BY round(score, 9) DESC, item ASC) AS rank FROM lat QUALIFY rank <= 1000",
    "qrels": """SELECT b.item_id::VARCHAR AS query, d.doc_id::VARCHAR AS item, 1 + CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS grade
        FROM documents d JOIN benchmark b ON trim(b.text) != '' AND contains(d.text, trim(b.text))
        LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id""",
    "judged": f"""SELECT * FROM (SELECT c.query, c.config, c.item, coalesce(l.score, 0) AS score, row_number() OVER (PARTITION BY c.query, c.config ORDER BY round(coalesce(l.score, 0), 9) DESC, c.item ASC) AS rank
        FROM (SELECT q.query, k.config, i.item FROM (SELECT DISTINCT query FROM qrels) q, (SELECT unnest({CONFIG_LIST}) AS config) k, items i) c
        LEFT JOIN lat l ON l.query = c.query AND l.config = c.config AND l.item = c.item) WHERE rank <= 1000""",
    "ideal": """SELECT query, sum(CASE WHEN p <= 10 THEN grade / log2(p + 1e0) END) AS ideal, count(*) FILTER (grade > 0) AS positives
        FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item ASC) AS p FROM qrels) GROUP BY 1""",
    "met": """SELECT j.query, j.config, coalesce(sum(CASE WHEN j.rank <= 10 THEN q.grade / log2(j.rank + 1e0) END), 0) / max(i.ideal) AS ndcg10,
        coalesce(1e0 / min(CASE WHEN j.rank <= 10 AND q.grade > 0 THEN j.rank END), 0) AS mrr10,
        (count(*) FILTER (q.grade > 0 AND j.rank <= 100))::DOUBLE / max(i.positives) AS recall100, (count(*) FILTER (q.grade > 0))::DOUBLE / max(i.positives) AS recall1000
        FROM judged j JOIN ideal i USING (query) LEFT JOIN qrels q ON q.query = j.query AND q.item = j.item GROUP BY 1, 2""",
    "oc": "SELECT query, config, round(ndcg10, 9) AS value FROM met",
    "wide": "SELECT query, " + ", ".join(f"max(CASE WHEN config = '{x[1:]}' THEN value END) AS c{x[1:]}" for x in _S) + " FROM oc GROUP BY 1",
    "vec": "SELECT vec_id, vec_id::VARCHAR AS item, embedding::DOUBLE[] AS v, label FROM embeddings",
    "dense": """SELECT q.item AS query, d.item, list_dot_product(q.v, d.v) AS score FROM vec q, vec d WHERE q.item != d.item""",
    "dtop": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item ASC) AS rank FROM dense QUALIFY rank <= 100",
    "dims": "SELECT vec_id, vec_id // 16 AS page, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "ends": "SELECT page, d, min(x) AS low, max(x) AS high, count(*) AS tokens FROM dims GROUP BY 1, 2",
    "pg": "SELECT page, list(low ORDER BY d) AS low, list(high ORDER BY d) AS high, max(tokens)::BIGINT AS tokens, sqrt(sum(low * low + high * high)) AS length FROM ends GROUP BY 1",
    "crit": """SELECT q.vec_id AS unit, p.page, p.tokens, list_sum(list_transform(q.v, lambda x, i: x * CASE WHEN x >= 0 THEN p.high[i] ELSE p.low[i] END)) AS score FROM vec q, pg p""",
    "psel": """SELECT * FROM (SELECT *, floor((128 - sum(CASE WHEN mandatory THEN tokens ELSE 0 END) OVER (PARTITION BY unit)) / 16) AS take,
        row_number() OVER (PARTITION BY unit, mandatory ORDER BY round(score, 9) DESC, page) AS place
        FROM (SELECT *, page = max(page) OVER (PARTITION BY unit) AS mandatory FROM crit)) WHERE mandatory OR place <= take""",
    "cent": "SELECT label AS expert, d, avg(x) AS c FROM dims JOIN embeddings USING (vec_id) GROUP BY 1, 2",
    "logit": "SELECT vec_id AS unit, expert, sum(x * c) AS logit FROM dims JOIN cent USING (d) GROUP BY 1, 2",
    "prob": "SELECT unit, expert, logit, e / sum(e) OVER (PARTITION BY unit) AS p FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY unit)) AS e FROM logit)",
    "obs": """SELECT x.expert, coalesce(t.counts, 0)::BIGINT AS counts, coalesce(t.mass, 0) AS mass, (SELECT count(DISTINCT unit) FROM prob)::BIGINT AS opportunities
        FROM (SELECT DISTINCT expert FROM prob) x LEFT JOIN (SELECT expert, count(*) AS counts, sum(p) AS mass FROM
        (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(p, 9) DESC, expert) AS place FROM prob) WHERE place <= 2 GROUP BY 1) t USING (expert)""",
}


def sql(body: str) -> str:
    """``body`` with the expressions it uses, directly or through others."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                need.add(name)
                add(CTES[name])

    add(body)
    if not need:
        return body
    joined = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need)
    own = body.lstrip()
    return f"WITH {joined},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {joined}\n{own}"
