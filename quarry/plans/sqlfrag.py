"""DuckDB SQL fragments shared by the oracle queries."""

from __future__ import annotations

# Same whitespace class as quarry.functions.text.WHITESPACE_RUN, in RE2 syntax.
WS = (r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def tok(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '{WS}'), lambda t: t <> '')"


def bm25_ctes(corpus: str, questions: str) -> str:
    """CTEs ``st, p, idf, w, qt, s`` for BM25 over ``corpus(doc_id, text)`` and
    ``questions(qid, question)``; ``s`` = (qid, doc_id, score) for hit pairs."""
    return f"""
d AS MATERIALIZED (SELECT doc_id, {tok('text')} AS toks FROM {corpus}),
st AS MATERIALIZED (SELECT count(*) AS n_docs, sum(coalesce(len(toks), 0)) AS n_tokens,
              sum(coalesce(len(toks), 0))::DOUBLE / count(*) AS avgdl FROM d),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
      FROM (SELECT doc_id, coalesce(len(toks), 0) AS dl, unnest(toks) AS term FROM d)
      GROUP BY doc_id, term),
dfr AS MATERIALIZED (SELECT term, count(*) AS df,
               ln((SELECT n_docs FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
        FROM p GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM dfr)
                              ELSE raw_idf END AS idf FROM dfr),
w AS (SELECT term, doc_id, tf, dl,
             tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM st))) AS w FROM p),
qt AS (SELECT qid, term, count(*) AS qtf
       FROM (SELECT qid, unnest({tok('question')}) AS term FROM {questions})
       GROUP BY qid, term),
s AS (SELECT qid, doc_id, sum(qtf * idf * w) AS score
      FROM qt JOIN idf USING (term) JOIN w USING (term) GROUP BY qid, doc_id)"""


COMMENTS = "(SELECT doc_id, text, source AS match, n_chars AS upvotes FROM documents)"
QUESTIONS = "(SELECT item_id AS qid, text AS question FROM benchmark)"
QVEC = ("(SELECT b.item_id AS qid, b.text AS question, e.embedding FROM benchmark b "
        "LEFT JOIN embeddings e ON e.vec_id = b.item_id)")
COLLECTION = ("(SELECT d.doc_id, d.text, d.source AS match, d.n_chars AS upvotes, e.embedding "
              "FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)")


def sqdist(a: str, b: str) -> str:
    """Squared L2 distance of two float lists, elements cast to double."""
    return (f"list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))")
