"""Pieces shared by the check SQL (DuckDB dialect), written independently of the operators."""

from __future__ import annotations

# Fixed values, stated here once more so that a change of the operators' lists shows.
CLASSIFIERS = ["type", "classe", "categorie", "niveau", "phase", "etape", "version"]
STOPWORDS = (
    "quoi quel quelle quels quelles est sont une des les pour dans avec que qui comment pourquoi"
).split()
# character references that the given pages use
REFERENCES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
    ("&middot;", "·"), ("&amp;", "&"),
]

# white space as a RE2 class
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def normalized(col: str) -> str:
    return f"strip_accents(lower({col}))"


def tokens(col: str) -> str:
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}]+')"


def keywords(text: str) -> str:
    """Keyword list of an already normalised text."""
    lists = [
        rf"list_transform(regexp_extract_all({text}, '{c}[{WS}]*([a-z0-9]+|[ivxlc]+)', 1), "
        rf"lambda v: '{c} ' || upper(v))"
        for c in CLASSIFIERS
    ]
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    words = (
        rf"list_filter(string_split_regex({text}, '[^\p{{L}}\p{{N}}_]+'), "
        rf"lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains([{stop}], w))"
    )
    joined = lists[0]
    for part in [*lists[1:], words]:
        joined = f"list_concat({joined}, {part})"
    return joined


def title_boost(title: str, kw: str, top: float = 0.15) -> str:
    primary = " OR ".join(f"starts_with(lower(k), '{c}')" for c in CLASSIFIERS)
    worth = f"CASE WHEN {primary} THEN {top}::DOUBLE * 2 / 3 ELSE {top}::DOUBLE / 5 END"
    return (
        f"least(coalesce(list_sum(list_transform(list_filter({kw}, "
        f"lambda k: contains({normalized(title)}, lower(k))), lambda k: {worth})), 0.0), "
        f"{top}::DOUBLE)"
    )


def is_toc(content: str) -> str:
    text = strip(content)
    lines = f"string_split({text}, chr(10))"
    score = (
        f"list_sum(list_transform({lines}, lambda x: "
        rf"regexp_matches({strip('x')}, '[{WS}.]\p{{Nd}}{{1,3}}$')::INT + contains(x, '...')::INT))"
    )
    return (
        f"(length({text}) >= 10 AND ("
        rf"regexp_matches({content}, '(?i)table[{WS}]*(des[{WS}]*)?mati[èe]res?')"
        rf" OR regexp_matches({content}, '(?i)^[{WS}]*sommaire[{WS}]*$')"
        rf" OR regexp_matches({content}, '(?i)^[{WS}]*contents?[{WS}]*$')"
        f" OR {score} / len({lines})::DOUBLE > 0.4"
        rf" OR regexp_matches({content}, '(?im)\.{{3,}}[{WS}]*\p{{Nd}}+')"
        rf" OR regexp_matches({content}, '(?im)^[A-Z{WS}\.]+[{WS}]+\p{{Nd}}+[{WS}]*$')"
        rf" OR regexp_matches({content}, '(?im)^\p{{Nd}}+\.[{WS}]+.{{5,50}}[{WS}]+\p{{Nd}}+[{WS}]*$')))"
    )


def html_to_text(html: str) -> str:
    """Markdown of the given pages, by replacements in another order than the operator's."""
    steps = [
        ("(?is)<(?:script|style)\\b.*?</(?:script|style)>", ""),
        ("(?s)<!--.*?-->", ""),
        ("(?is)<head\\b.*?</head>", ""),
        ("(?is)<nav\\b.*?</nav>", ""),
        ("(?i)<br[^>]*>", "\n"),
        *[(f"(?i)<h{n}(?:[ ][^>]*)?>", "\n" + n * "#" + " ") for n in (1, 2, 3, 4, 5, 6)],
        ("(?i)</?(?:p|div|article|section|main|footer|header|aside|ul|ol|table|blockquote|form|figure|pre|dl|dt|dd|hr)"
         "(?:[ ][^>]*)?>|</(?:h[1-6]|li|tr)>", "\n"),
        ("(?i)<li(?:[ ][^>]*)?>", "\n- "),
        ("(?is)<a [^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[\\2](\\1)"),
        ("<[^>]*>", ""),
    ]
    text = html
    for pattern, by in steps:
        pattern, by = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in (pattern, by))
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    for name, char in REFERENCES:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    text = rf"regexp_replace({text}, '[ \t\r]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' ?\n[\n ]*', chr(10), 'g')"
    return strip(text)


def cosine(a: str, b: str) -> str:
    a, b = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    return (
        f"round(list_dot_product({a}, {b}) / "
        f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 12)"
    )


CORPUS = f"""
chunks AS (
  SELECT d.doc_id AS chunk_id, d.source AS document_id, d.text AS content, e.embedding,
         {is_toc('d.text')} AS is_toc
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
docs AS (
  SELECT source AS document_id, arg_min(split_part(text, chr(10), 1), doc_id) AS title,
         source || '.md' AS source
  FROM documents GROUP BY documents.source),
asked AS (
  SELECT b.item_id AS query_id, b.text AS query, e.embedding
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)
"""


def nearest(name: str, k: int, threshold: float, toc: bool) -> str:
    """CTE with the ranked vector leg."""
    where = "AND NOT c.is_toc" if toc else ""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
    FROM (SELECT q.query_id, c.chunk_id, c.document_id,
                 {cosine('c.embedding', 'q.embedding')} AS similarity
          FROM asked q, chunks c
          WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL {where})
    WHERE similarity >= {threshold}) WHERE rank <= {k})
"""


def keyword_ctes(queries: str, chunks: str, words=tokens) -> str:
    """CTEs up to ``scored(query_id, chunk_id, rank_cd)``: every match of every query. ``words``
    gives the analysed words of a text, empty ones where a word is left out."""
    tokens = words
    return rf"""
toks AS (SELECT chunk_id, {tokens('content')} AS toks FROM {chunks}),
places AS (SELECT chunk_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM toks),
pieces AS (
  SELECT query_id, unnest(ps) AS piece, unnest(range(len(ps))) AS no FROM (
    SELECT query_id, regexp_extract_all(query, '-?"[^"]*"|[^\s"]+') AS ps FROM {queries})),
items AS (
  SELECT query_id, alt, no, starts_with(piece, '-') AS negated, {tokens('piece')} AS words
  FROM (SELECT *, sum((lower(piece) = 'or')::INT) OVER (PARTITION BY query_id ORDER BY no) AS alt
        FROM pieces)
  WHERE lower(piece) <> 'or' AND len(list_filter({tokens('piece')}, lambda w: w <> '')) > 0),
item_hits AS (
  SELECT DISTINCT query_id, no, chunk_id FROM (
    SELECT i.query_id, i.no, p.chunk_id
    FROM (SELECT query_id, no, len(list_filter(words, lambda w: w <> '')) AS m, unnest(words) AS w,
            unnest(range(len(words))) AS j FROM items) i JOIN places p ON p.term = i.w AND i.w <> ''
    GROUP BY i.query_id, i.no, p.chunk_id, p.pos - i.j, i.m HAVING count(*) = i.m)),
checked AS (
  SELECT i.query_id, i.alt, t.chunk_id,
         bool_and(i.negated <> (h.chunk_id IS NOT NULL)) AS ok
  FROM items i CROSS JOIN (SELECT chunk_id FROM toks) t
  LEFT JOIN item_hits h ON h.query_id = i.query_id AND h.no = i.no AND h.chunk_id = t.chunk_id
  GROUP BY ALL),
hit AS (SELECT query_id, chunk_id FROM checked GROUP BY ALL HAVING bool_or(ok)),
terms AS (SELECT DISTINCT query_id, alt, unnest(list_filter(words, lambda w: w <> '')) AS term FROM items WHERE NOT negated),
entries AS (
  SELECT h.query_id, h.chunk_id, p.pos, p.term,
         row_number() OVER (PARTITION BY h.query_id, h.chunk_id ORDER BY p.pos) AS no
  FROM hit h JOIN places p USING (chunk_id)
  JOIN (SELECT DISTINCT query_id, term FROM terms) t
    ON t.query_id = h.query_id AND t.term = p.term),
seen AS (
  SELECT e.query_id, e.chunk_id, e.no, e.pos, t.alt,
         max(CASE WHEN e.term = t.term THEN e.no END) OVER (
           PARTITION BY e.query_id, e.chunk_id, t.alt, t.term ORDER BY e.no) AS last_no
  FROM entries e JOIN terms t USING (query_id)),
begins AS (
  SELECT query_id, chunk_id, no, pos, max(st) AS st FROM (
    SELECT query_id, chunk_id, no, pos, alt,
           CASE WHEN count(last_no) = count(*) THEN min(last_no) ELSE 0 END AS st
    FROM seen GROUP BY ALL) GROUP BY ALL),
covers AS (
  SELECT *, lag(st, 1, 0) OVER (PARTITION BY query_id, chunk_id ORDER BY no) AS prev FROM begins),
scored AS (
  SELECT h.query_id, h.chunk_id, round(coalesce(sum(0.1::DOUBLE
           / (1 + (c.pos - b.pos) - (c.no - c.st))), 0), 12) AS rank_cd
  FROM hit h
  LEFT JOIN covers c ON c.query_id = h.query_id AND c.chunk_id = h.chunk_id AND c.st > c.prev
  LEFT JOIN entries b ON b.query_id = c.query_id AND b.chunk_id = c.chunk_id AND b.no = c.st
  GROUP BY ALL)
"""


def keyword_leg(k: int) -> str:
    return f"""
text_leg AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY query_id ORDER BY rank_cd DESC, chunk_id) AS rank FROM scored)
  WHERE rank <= {k})
"""


def fusion(k: int = 30, threshold: float = 0.30, rrf_k: int = 50, cap: int = 3) -> str:
    """CTEs up to ``fused`` (all candidates), ``capped`` and ``hybrid`` (final rows)."""
    return f"""
{keyword_ctes('asked', '(SELECT * FROM chunks WHERE NOT is_toc)')},
{keyword_leg(3 * k)},
{nearest('vector_leg', 3 * k, threshold, True)},
fused AS (
  SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.chunk_id, s.chunk_id) AS chunk_id,
         f.rank AS text_rank, s.rank AS vector_rank,
         coalesce(1.0::DOUBLE / ({rrf_k} + f.rank), 0) + coalesce(1.0::DOUBLE / ({rrf_k} + s.rank), 0)
           AS score
  FROM text_leg f FULL JOIN vector_leg s
    ON f.query_id = s.query_id AND f.chunk_id = s.chunk_id),
placed AS (
  SELECT f.*, c.document_id, c.content, d.title AS document_title, d.source AS document_source,
         CASE WHEN c.embedding IS NOT NULL AND q.embedding IS NOT NULL
           THEN {cosine('c.embedding', 'q.embedding')} END AS similarity
  FROM fused f JOIN chunks c USING (chunk_id) JOIN docs d ON d.document_id = c.document_id
  JOIN asked q ON q.query_id = f.query_id),
capped AS (
  SELECT *, row_number() OVER (
    PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS doc_rank
  FROM placed QUALIFY doc_rank <= {cap}),
hybrid AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM capped QUALIFY rank <= {k})
"""


RERANKED = f"""
words AS (SELECT query_id, {keywords('t')} AS kw
          FROM (SELECT query_id, {normalized('query')} AS t FROM asked)),
boosted AS (
  SELECT h.* EXCLUDE (similarity), len(w.kw) > 0 AS has_words, b.boost,
         CASE WHEN b.boost > 0 AND h.similarity IS NOT NULL THEN least(h.similarity + b.boost, 1.0)
              ELSE h.similarity END AS similarity
  FROM hybrid h JOIN words w USING (query_id),
  LATERAL (SELECT {title_boost('h.document_title', 'w.kw')} AS boost) b),
final AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
    CASE WHEN has_words THEN coalesce(similarity, -2) ELSE score END DESC, score DESC, chunk_id)
    AS position FROM boosted)
"""
