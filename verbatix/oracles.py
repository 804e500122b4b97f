"""SQL twins (DuckDB) of the registered queries. They share tables, words, stems and postings as common
table expressions; a twin takes the ones that it needs."""

from __future__ import annotations

from . import corpus
from .functions.text import STOPWORDS, SUFFIXES
from .operators.ranking import EVIDENCE
from .plans.catalog import ARCHIVED
from .sources.pages import SHORT_CAPITALS


def _values(rows) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def _words(text: str) -> str:
    return f"string_split_regex(strip_accents(lower({text})), '[^a-z0-9]+')"


def _stem(w: str) -> str:
    rules = []
    for pattern, to in SUFFIXES:
        cut = f"regexp_replace({w}, '{pattern}', '{to.replace('$1', chr(92) + '1')}')"
        rules.append(f"CASE WHEN {cut} <> {w} AND length({cut}) >= 4 THEN {cut} END")
    return f"coalesce({', '.join(rules)}, {w})"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_IS_TERM = f"length(word) >= 2 AND word NOT IN ({_STOP}) AND NOT regexp_matches(word, '^[0-9]{{5,}}$')"


def _stemmed(source: str) -> str:
    """word and term of the distinct words of ``source``."""
    return f"""
      SELECT word, CASE WHEN length(word) < 5 THEN word WHEN length(e) > 4 AND right(e, 1) = e[length(e) - 1] THEN left(e, length(e) - 1) ELSE e END AS term
      FROM (SELECT word, CASE WHEN length(c) > 4 AND right(c, 1) = 'e' THEN left(c, length(c) - 1) ELSE c END AS e
            FROM (SELECT word, {_stem("word")} AS c FROM (SELECT DISTINCT word FROM {source})))"""


CTE = {
    "d": """SELECT doc_id::VARCHAR AS document_id, lang AS group_id, text, source AS collection,
      array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:6], ' ') AS title,
      'https://corpus.example/' || source || '/' || doc_id AS source_url, 'official_webpage' AS source_type,
      sha256(text) AS checksum, length(text)::INTEGER AS char_count FROM documents""",
    "cut": """SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n) - 1 AS ord FROM (
      SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT document_id, group_id, title, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM d))
      WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''""",
    "p": """SELECT document_id || ':' || ord AS passage_id, document_id, group_id, ord::INTEGER AS ord,
      trim(line, ' ' || chr(9) || chr(13)) AS text, title AS heading FROM cut""",
    "w": f"""SELECT * FROM (
      SELECT passage_id, 0 AS f, unnest({_words("text")}) AS word FROM p
      UNION ALL SELECT passage_id, 1, unnest({_words("heading")}) FROM p) WHERE {_IS_TERM}""",
    "v": _stemmed("w"),
    "post": """SELECT passage_id, term, count(*) FILTER (WHERE f = 0) AS in_text, count(*) FILTER (WHERE f = 1) AS in_heading
      FROM w JOIN v USING (word) GROUP BY passage_id, term""",
    "len": "SELECT passage_id, sum(in_text + in_heading)::BIGINT AS dl FROM post GROUP BY passage_id",
    "terms": "SELECT term, count(*) AS df, left(term, 5) AS p5 FROM post GROUP BY term",
    "stats": "SELECT (SELECT count(DISTINCT passage_id) FROM p) AS n_passages, (SELECT coalesce(sum(dl), 0)::BIGINT FROM len) AS n_tokens",
    "qw": f"SELECT * FROM (SELECT query_id, unnest({_words('query')}) AS word, unnest(range(len({_words('query')}))) AS place FROM q) WHERE {_IS_TERM}",
    "qv": _stemmed("qw"),
    "qt": """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY place) - 1)::INTEGER AS q, stem, length(stem) >= 5 AS is_prefix,
      least(60, count(*) OVER (PARTITION BY query_id))::INTEGER AS n_terms
      FROM (SELECT query_id, term AS stem, min(place) AS place FROM qw JOIN qv USING (word) GROUP BY query_id, term)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 60""",
    "found": """SELECT query_id, q, n_terms, passage_id, sum(in_text + 2 * in_heading) AS tf, max((in_text > 0)::INTEGER) AS covers
      FROM qt JOIN post ON term = stem OR (is_prefix AND starts_with(term, stem)) GROUP BY query_id, q, n_terms, passage_id""",
    "idf": """SELECT query_id, q, greatest(ln(((SELECT n_passages FROM stats) - n + 0.5) / (n + 0.5)), 1e-6) AS idf
      FROM (SELECT query_id, q, count(*) AS n FROM found GROUP BY query_id, q)""",
    "hit": """SELECT query_id, passage_id, any_value(n_terms) AS n_terms, sum(covers)::INTEGER AS coverage,
      sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT n_tokens::DOUBLE / n_passages FROM stats)))) AS score
      FROM found JOIN idf USING (query_id, q) JOIN len USING (passage_id) GROUP BY query_id, passage_id""",
    "kw": """SELECT DISTINCT topic, keyword, no, term FROM (
      SELECT topic, keyword, no, word, term FROM kww JOIN kwv USING (word))""",
    "kwn": "SELECT topic, keyword, no, count(*) AS n_terms FROM kw GROUP BY ALL",
    "kwm": """SELECT passage_id, topic, no, keyword FROM (
      SELECT passage_id, topic, no, keyword, count(*) AS n FROM post JOIN kw USING (term) WHERE in_text > 0 GROUP BY ALL)
      JOIN kwn USING (topic, no, keyword) WHERE n = n_terms""",
    "tags": "SELECT passage_id, topic FROM kwm GROUP BY ALL HAVING count(*) >= 2",
}
CTE["kww"] = f"SELECT * FROM (SELECT topic, keyword, no, unnest({_words('keyword')}) AS word FROM ({_values((t.id, k, n) for t in corpus.TOPICS for n, k in enumerate(t.keywords))}) AS x(topic, keyword, no)) WHERE {_IS_TERM}"
CTE["kwv"] = _stemmed("kww")
CTE["g"] = f"SELECT * FROM ({_values((g.id, n, g.name, g.short_name, g.representative, g.bloc) for n, g in enumerate(corpus.GROUPS))}) AS x(group_id, ordinal, group_name, short_name, representative, bloc)"

_SPACES = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _normalized(line: str) -> str:
    """The rewrites of a line. This engine looks neither back nor ahead: what stands beside a match is put back."""
    rules = (
        ("�+", " "), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]", " "), ("[\\x{a0}\\x{2002}\\x{2003}\\x{2009}\\x{200a}\\x{200b}\\x{202f}]", " "),
        ("ﬁ", "fi"), ("ﬂ", "fl"), ("[‘’]", "\'\'"), ("[“”]", '"'), ("[–—]", "–"), ("(^|[^A-Za-z0-9_])f ([ilr][a-zà-ÿ]+)", "\\1f\\2"),
        (f"(?:{_SPACES}*\\.){{4,}}{_SPACES}*", " "), (f"p\\.{_SPACES}?[0-9]{{1,3}}\\b", " "), (f"\\bPAGE{_SPACES}+[0-9]{{1,3}}\\b", " "),
        ("^[0-9]{1,3}([A-ZÀ-Ý]{2})", "\\1"), (f"{_SPACES}+([.,])", "\\1"), (f"{_SPACES}+", " "),
    )
    for pattern, to in rules:
        line = f"regexp_replace({line}, '{pattern}', '{to}', 'g')"
    return f"trim({line}, ' ')"


_CAPITALS = "[^A-ZÀ-Ý]"


def _is_capital(line: str, least: int, share: float) -> str:
    letters = f"length(regexp_replace({line}, '[^A-Za-zÀ-ÿ]', '', 'g'))"
    return f"({letters} >= {least} AND length(regexp_replace({line}, '{_CAPITALS}', '', 'g')) >= {share} * {letters})"


_SPLIT = "list_filter(string_split({0}, ' '), lambda t: t <> '')"


def _undoubled(line: str) -> str:
    """Lines mostly of capitals: tokens that are one string twice are halved, of equal neighbours the first one stays."""
    halved = f"list_transform({_SPLIT.format(line)}, lambda t: CASE WHEN length(t) >= 6 AND t = repeat(left(t, length(t) // 2), 2) THEN left(t, length(t) // 2) ELSE t END)"
    single = f"array_to_string(list_filter({halved}, lambda t, i: i = 1 OR lower(t) <> lower(({halved})[i - 1])), ' ')"
    return f"CASE WHEN {_is_capital(line, 6, 0.6)} THEN {single} ELSE {line} END"


# Pages as ``corpus.paged`` lays them out.
CTE["raw_line"] = f"""SELECT document_id, page, n, {_undoubled("line")} AS line FROM (
  SELECT document_id, page, n, {_normalized("line")} AS line FROM (
    SELECT document_id, n // 3 AS page, n % 3 AS n, line FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM d)
    UNION ALL SELECT document_id, unnest(range((len(string_split(text, chr(10))) + 2) // 3)), -1, 'CORPUS OF ' || upper(collection) || ' READER' FROM d
    UNION ALL SELECT document_id, n, 3, '- ' || (n + 1) || ' -' FROM (SELECT document_id, unnest(range((len(string_split(text, chr(10))) + 2) // 3)) AS n FROM d)))"""
CTE["line"] = f"""SELECT * FROM (SELECT document_id, page, n, line, {_SPLIT.format("line")} AS tokens FROM raw_line)
  WHERE NOT (len(tokens) >= 6 AND len(list_filter(tokens, lambda t: length(t) = 1)) / len(tokens) > 0.5)"""
CTE["gram"] = """SELECT document_id, ngram, count(DISTINCT page) AS n_pages FROM (
  SELECT document_id, page, array_to_string(tokens[i:i + k - 1], ' ') AS ngram FROM (SELECT *, unnest(range(1, len(tokens) - k + 2)) AS i FROM line, range(3, 15) AS x(k) WHERE len(tokens) >= k))
  GROUP BY document_id, ngram"""

CTE["top"] = """SELECT document_id, ngram FROM gram JOIN (SELECT document_id, max(page) + 1 AS n FROM raw_line GROUP BY document_id) USING (document_id)
  WHERE n >= 4 AND n_pages >= greatest(3, ceil(n * 0.4))"""
CTE["header"] = """SELECT document_id, list(ngram ORDER BY -length(ngram), ngram) AS furniture FROM top f
  WHERE NOT EXISTS (SELECT 1 FROM top g WHERE g.document_id = f.document_id AND g.ngram <> f.ngram AND contains(g.ngram, f.ngram)) GROUP BY document_id"""
_HEADERS = "d raw_line line gram top header".split()
# headers go one after the other, longest first; then fragments of capitals join their neighbours
CTE["clean"] = """SELECT document_id, page, n, line, trim(regexp_replace(list_reduce(list_prepend(line, coalesce(furniture, [])), lambda t, h: replace(t, h, ' ')), '\\s+', ' ', 'g'), ' ') AS c
  FROM line LEFT JOIN header USING (document_id)"""
CTE["token"] = f"""SELECT *, list_transform(ts, lambda t, i: length(t) <= 2 AND regexp_full_match(t, '[A-ZÀ-Ý]+') AND NOT list_contains(short, t)) AS fragment,
    list_transform(ts, lambda t, i: length(t) <= 2 AND regexp_full_match(t, '[A-ZÀ-Ý]+') AND NOT list_contains(short, t) AND i < len(ts) AND NOT list_contains(short, ts[i + 1])) AS eager
  FROM (SELECT *, {_SPLIT.format("c")} AS ts, [{", ".join(f"'{w}'" for w in SHORT_CAPITALS)}] AS short, {_is_capital("c", 4, 0.8)} AS capital FROM clean)"""
CTE["joined"] = f"""SELECT document_id, page, n, line, {_undoubled("j")} AS c FROM (
  SELECT *, CASE WHEN capital AND len(ts) >= 3 THEN array_to_string(list_transform(ts, lambda t, i: CASE WHEN i = 1 OR joins[i - 1] OR (fragment[i] AND NOT joins[i]) THEN '' ELSE ' ' END || t), '') ELSE c END AS j FROM (
    SELECT *, list_transform(eager, lambda e, i: e AND (i - list_max(list_filter(range(0, i), lambda k: k = 0 OR NOT eager[k]))) % 2 = 1) AS joins FROM token))"""
CTE["kept"] = """SELECT * FROM (
  SELECT document_id, page, n, CASE WHEN line = '' THEN '' ELSE c END AS t FROM joined WHERE line = '' OR (c <> '' AND NOT regexp_full_match(c, '[-–—\\s]*[0-9]{1,3}[-–—\\s]*')))"""
CTE["flag"] = """SELECT *, b AND NOT coalesce(regexp_matches(before, '[a-zà-ÿ]-$') AND regexp_matches(t, '^[a-zà-ÿ]'), FALSE) AS spaced FROM (
  SELECT *, NOT (before IS NULL OR before = '' OR t = '' OR (regexp_matches(before, '[.!?:»]$') AND regexp_matches(t, '^[•▪●–—-]\\s|^[A-ZÀ-Ý0-9]'))) AS b
  FROM (SELECT *, lag(t) OVER (PARTITION BY document_id, page ORDER BY n) AS before FROM kept))"""
CTE["paragraph"] = f"""SELECT document_id, page, no, {_undoubled("text")} AS text FROM (
  SELECT document_id, page, no, trim(string_agg(CASE WHEN spaced THEN ' ' ELSE '' END || CASE WHEN gives THEN regexp_replace(t, '-$', '') ELSE t END, '' ORDER BY n), ' ') AS text FROM (
    SELECT *, sum((NOT b)::INTEGER) OVER w AS no, coalesce(lead(b AND NOT spaced) OVER w, FALSE) AS gives FROM flag WINDOW w AS (PARTITION BY document_id, page ORDER BY n))
  GROUP BY document_id, page, no)"""

_POSTINGS = "d cut p w v post".split()
_TAGS = [*_POSTINGS, *"kww kwv kw kwn kwm tags".split()]
_HITS = [*_POSTINGS, *"len stats q qw qv qt found idf hit".split()]


def _with(names, body: str, **more: str) -> str:
    table = CTE | more
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({table[n]})" for n in names) + "\n" + body


def _queries(*rows) -> str:
    return f"SELECT * FROM ({_values(rows or corpus.SEARCHES)}) AS x(query_id, query)"


_NEED = "CASE WHEN n_terms <= 2 THEN n_terms ELSE least(3, ceil(n_terms / 2.0)) END"


def _ranking(limit: int, where: str = "TRUE", capped: bool = True) -> str:
    """The ranking rules over ``hit``: candidates, coverage, floor, cap, limit."""
    order = "ORDER BY round(score, 9) DESC, passage_id"
    cap = max(2, -(-limit // 3)) if capped else 1 << 30
    return f"""
      , c AS (SELECT * FROM hit JOIN (SELECT passage_id, document_id, group_id FROM p) USING (passage_id) WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY query_id {order}) <= {4 * limit}),
      f AS (SELECT * FROM c WHERE coverage >= {_NEED} QUALIFY score >= 0.25 * max(score) OVER (PARTITION BY query_id)),
      k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, group_id {order}) <= {cap}),
      r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id {order})::INTEGER AS rank FROM k) WHERE rank <= {limit})
      """


def _search(rows, limit: int, where: str = "TRUE", capped: bool = True, extra=(), **more: str) -> str:
    shown = "SELECT query_id, rank, passage_id, document_id, group_id, round(score, 6) AS score, coverage FROM r"
    return _with([*_HITS, *extra], _ranking(limit, where, capped) + shown, q=_queries(*rows), **more)


_CANDIDATES = """, c AS (SELECT * FROM (
  SELECT query_id, passage_id, group_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id)::INTEGER AS candidate
  FROM hit JOIN (SELECT passage_id, group_id FROM p) USING (passage_id)) WHERE candidate <= 40)"""
_LEVEL = "CASE WHEN {0} >= 2 THEN 'direct_quote' WHEN {0} = 1 THEN 'clear_paraphrase' WHEN {0} = 0 THEN 'weak_inference' ELSE 'not_found' END"


def _topic_search(per_group: int) -> str:
    topics = _values((t.id, " ".join(t.keywords)) for t in corpus.TOPICS)
    names = [*_HITS, *"kww kwv kw kwn kwm".split()]
    return _with(names, f"""
      , c AS (SELECT * FROM hit JOIN (SELECT passage_id, document_id, group_id FROM p) USING (passage_id)
        QUALIFY row_number() OVER (PARTITION BY query_id, group_id ORDER BY round(score, 9) DESC, passage_id) <= {max(15, 4 * per_group)}),
      b AS (SELECT c.* EXCLUDE (score), m.matched, coalesce(m.n, 0) AS n, score * (1 + 0.15 * coalesce(m.n, 0)) AS score FROM c LEFT JOIN (
        SELECT passage_id, topic, string_agg(keyword, ',' ORDER BY no) AS matched, count(*) AS n FROM kwm GROUP BY ALL) m
        ON m.passage_id = c.passage_id AND m.topic = c.query_id),
      f AS (SELECT * FROM b QUALIFY score >= 0.25 * max(score) OVER (PARTITION BY query_id, group_id)),
      r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY round(score, 9) DESC, passage_id)::INTEGER AS rank FROM f) WHERE rank <= {per_group})
      """, q=f"SELECT * FROM ({topics}) AS x(query_id, query)")  # fmt: skip


_HEADING = """length(t) BETWEEN 4 AND 110 AND length(t) - length(replace(t, ' ', '')) <= 15 AND NOT regexp_matches(t, '[.!?;]$')
  AND NOT regexp_matches(t, '^[•▪●–—-]\\s') AND NOT regexp_matches(t, '^[a-zà-ÿ]')
  AND NOT regexp_matches(t, '^©') AND NOT regexp_matches(t, '(?i)^cr[ée]dits?\\s+(photos?|images?|iconographi)')
  AND NOT regexp_matches(t, '(?i)^(photos?|illustrations?)\\s*[:—-]')
  AND NOT regexp_matches(t, '(?i)\\b(adobe stock|istock|shutterstock|getty|unsplash|flickr|wikimedia)\\b')
  AND NOT regexp_matches(t, '(?i)^(sommaire|table des matières|introduction|édito|editorial|remerciements)\\b')
  AND NOT regexp_matches(t, '^\\p{Lu}[\\p{L}''’-]+ \\p{Lu}[\\p{L}''’-]+, [a-zà-ÿ]')
  AND NOT regexp_matches(t, '^\\p{Lu}[\\p{L}''’-]+ \\p{Lu}[\\p{L}''’-]+,? ?(20[0-9][0-9])$')
  AND NOT (length(strip_accents(lower(t))) > 6 AND contains(strip_accents(lower(title)), strip_accents(lower(t))))
  AND (regexp_matches(t, '^[0-9]{1,3}\\s*[_.)\\]–-]\\s+\\S') OR regexp_matches(t, '(?i)^(chapitre|partie|axe|thème|theme|pacte|proposition|mesure)\\b')
    OR (length(regexp_replace(t, '[^A-Za-zÀ-ÿ]', '', 'g')) >= 4 AND (
      length(regexp_replace(t, '[^A-ZÀ-Ý]', '', 'g')) / length(regexp_replace(t, '[^A-Za-zÀ-ÿ]', '', 'g')) > 0.7
      OR (length(t) <= 70 AND length(t) - length(replace(t, ' ', '')) <= 8))))"""

# Chunks: lines, then pieces of long lines, then the fold, a step for each piece of all documents at once.
CTE["lines"] = f"""SELECT document_id, ord, t, start, start + length(line) AS stop, start + length(line) - length(ltrim(line, ' ' || chr(9) || chr(13))) AS inner_start, is_heading FROM (
  SELECT *, {_HEADING} AS is_heading FROM (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM cut))"""
CTE["sentences"] = r"""SELECT document_id, ord, k, a, a + length(s) AS b, count(*) OVER (PARTITION BY document_id, ord) AS n FROM (
  SELECT *, inner_start + coalesce(sum(length(s) + 1) OVER (PARTITION BY document_id, ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
    SELECT document_id, ord, inner_start, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS k FROM (
      SELECT *, string_split(regexp_replace(t, '([.!?])\s', '\1' || chr(10), 'g'), chr(10)) AS ss FROM lines WHERE NOT is_heading AND length(t) > 1100)))"""
CTE["runs"] = """SELECT document_id, ord, k, a AS first, b, n, b - a >= 600 OR k = n AS done FROM sentences WHERE k = 1
  UNION ALL SELECT x.document_id, x.ord, x.k, CASE WHEN r.done THEN x.a ELSE r.first END, x.b, x.n, x.b - CASE WHEN r.done THEN x.a ELSE r.first END >= 600 OR x.k = x.n
  FROM runs r JOIN sentences x ON x.document_id = r.document_id AND x.ord = r.ord AND x.k = r.k + 1"""
CTE["pieces"] = """SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a) AS p, count(*) OVER (PARTITION BY document_id) AS n FROM (
  SELECT document_id, start AS a, stop AS b, is_heading, t FROM lines WHERE is_heading OR length(t) <= 1100
  UNION ALL SELECT document_id, first, b, FALSE, '' FROM runs WHERE done)"""
# held: the open chunk before the piece; closed: what the piece closes before itself (a heading) or with itself
CTE["folded"] = """SELECT document_id, p, n, is_heading::INTEGER AS section, is_heading::INTEGER AS home, a AS held, b AS upto, NULL::BIGINT AS closed, NULL::BIGINT AS closed_to, NULL::INTEGER AS closed_home,
    NOT is_heading AND b - a >= 600 OR n = 1 AS full_ FROM pieces WHERE p = 1
  UNION ALL SELECT document_id, p, n, section, CASE WHEN opens THEN section ELSE home END, CASE WHEN opens THEN a ELSE held END, b,
    CASE WHEN breaks THEN held END, CASE WHEN breaks THEN upto END, CASE WHEN breaks THEN home END, NOT is_heading AND b - CASE WHEN opens THEN a ELSE held END >= 600 OR p = n FROM (
    SELECT x.document_id, x.p, x.n, x.a, x.b, x.is_heading, f.section + x.is_heading::INTEGER AS section, f.home, f.held, f.upto,
      x.is_heading AND NOT f.full_ AND f.upto - f.held >= 120 AS breaks, f.full_ OR (x.is_heading AND f.upto - f.held >= 120) AS opens
    FROM folded f JOIN pieces x ON x.document_id = f.document_id AND x.p = f.p + 1)"""
CTE["heads"] = """SELECT document_id, 0 AS ord, title AS heading FROM d
  UNION ALL SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ord)::INTEGER, t FROM lines WHERE is_heading"""
CTE["chunk"] = """SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY char_start) - 1)::INTEGER AS ord FROM (
  SELECT document_id, closed_home AS home, closed AS char_start, closed_to AS char_end FROM folded WHERE closed IS NOT NULL
  UNION ALL SELECT document_id, home, held, upto FROM folded WHERE full_)"""
_CHUNKS = "d cut lines sentences runs pieces folded heads chunk".split()

SQL: dict[str, str] = {
    "tokenize_counts": _with("d p w v".split(), f"""
      SELECT document_id, (SELECT count(*) FROM unnest({_words("d.text")}) AS t(x) WHERE x <> '') AS n_words, coalesce(n_terms, 0) AS n_terms, coalesce(n_stems, 0) AS n_stems
      FROM d LEFT JOIN (SELECT passage_id, count(*) AS n_terms, count(DISTINCT term) AS n_stems FROM w JOIN v USING (word) GROUP BY passage_id) ON passage_id = document_id""",
      p="SELECT document_id AS passage_id, text, '' AS heading FROM d"),
    "stem_vocabulary": _with("d cut p w v".split(), "SELECT word, term FROM v"),
    "stem_convergence": _with("d cut p w v".split(), "SELECT left(word, 6) AS group_no, string_agg(DISTINCT term, '+' ORDER BY term) AS stems, count(DISTINCT term) = 1 AS converges FROM v WHERE length(word) >= 6 GROUP BY 1"),
    "match_terms": _with("q qw qv qt".split(), f"SELECT query_id, q, stem, is_prefix, n_terms, ({_NEED})::INTEGER AS required FROM qt", q="SELECT item_id AS query_id, text AS query FROM benchmark"),
    "postings": _with(_POSTINGS, "SELECT * FROM post"),
    "term_stats": _with([*_POSTINGS, "terms"], "SELECT * FROM terms"),
    "doc_lengths": _with([*_POSTINGS, "len"], "SELECT * FROM len"),
    "corpus_stats": _with([*_POSTINGS, "len", "stats"], "SELECT n_passages, n_tokens, round(n_tokens::DOUBLE / n_passages, 6) AS avgdl FROM stats"),
    "bm25_scores": _with(_HITS, "SELECT query_id, passage_id, round(score, 6) AS score, coverage, n_terms FROM hit", q=_queries()),
    "bm25_search": _search([corpus.SEARCHES[0]], 10),
    "bm25_search_documents": _search([corpus.SEARCHES[0]], 10, p="SELECT document_id AS passage_id, document_id, group_id, 0 AS ord, text, '' AS heading FROM d"),
    "bm25_search_group": _search([(0, corpus.SEARCHES[1][1])], 10, "group_id = 'fr'", capped=False),
    "bm25_search_topic": _search([corpus.SEARCHES[0]], 6, "passage_id IN (SELECT passage_id FROM tags WHERE topic = 'things')", extra="kww kwv kw kwn kwm tags".split()),
    "bm25_batch": _search(corpus.SEARCHES, 5),
    "bm25_block_max": _search(corpus.SEARCHES, 5),
    "full_hits": _with([*_HITS, *"kww kwv kw kwn kwm tags".split()], _ranking(5) + """
      SELECT query_id, rank, passage_id, r.document_id, r.group_id, round(score, 6) AS score, coverage, ord, p.text, heading, FALSE AS is_navigation, 0 AS section_ord, title, source_url, checksum, topic_tags
      FROM r JOIN (SELECT passage_id, ord, text, heading FROM p) p USING (passage_id) JOIN (SELECT document_id, title, source_url, checksum FROM d) USING (document_id)
      LEFT JOIN (SELECT passage_id, string_agg(topic, ',' ORDER BY topic) AS topic_tags FROM tags GROUP BY passage_id) USING (passage_id)""", q=_queries()),
    "search_not_found": _search([(0, corpus.SEARCHES[5][1])], 10),
    "coverage_filter": _with(_HITS, f"SELECT query_id, passage_id, round(score, 6) AS score, coverage FROM hit WHERE coverage >= {_NEED}", q=_queries()),
    "score_floor": _with(_HITS, _CANDIDATES + " SELECT query_id, passage_id, candidate, round(score, 6) AS score FROM c QUALIFY score >= 0.25 * max(score) OVER (PARTITION BY query_id)", q=_queries()),
    "group_cap": _with(_HITS, _CANDIDATES + " SELECT query_id, passage_id, group_id, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id, group_id ORDER BY candidate) <= 4", q=_queries()),
    "topic_search": _topic_search(2) + "SELECT query_id AS topic, rank, passage_id, document_id, group_id, round(score, 6) AS score, coalesce(matched, '') AS matched_keywords FROM r",
    "compare_groups": _topic_search(2) + f""", t AS (SELECT group_id, string_agg(passage_id, ',' ORDER BY rank) AS passage_ids, max(matched) FILTER (WHERE rank = 1) AS matched, max(n) FILTER (WHERE rank = 1) AS n FROM r WHERE query_id = 'things' GROUP BY group_id),
      y AS (SELECT ordinal AS position, group_id, n, coalesce(matched, '') AS matched_keywords, coalesce(passage_ids, '') AS passage_ids FROM (SELECT * FROM ({_values((g.id, n) for n, g in enumerate(corpus.GROUPS))}) AS x(group_id, ordinal)) LEFT JOIN t USING (group_id)),
      z AS (SELECT group_id, count(*) AS n_passages, count(DISTINCT document_id) AS n_documents FROM p GROUP BY group_id)
      SELECT position, group_id, {_LEVEL.format("n")} AS evidence_level, e.meaning AS evidence_explanation, matched_keywords, passage_ids, n_passages, n_documents
      FROM y JOIN z USING (group_id) JOIN ({_values(EVIDENCE.items())}) AS e(level, meaning) ON level = {_LEVEL.format("n")}""",
    "evidence_levels": _with([*_POSTINGS, *"kww kwv kw kwn kwm".split()], f"SELECT passage_id, topic, count(*) AS n_keywords, {_LEVEL.format('count(*)')} AS evidence_level FROM kwm GROUP BY passage_id, topic"),
    "tag_topics": _with(_TAGS, "SELECT * FROM tags"),
    "passage_tags": _with(_TAGS, "SELECT passage_id, coalesce(string_agg(topic, ',' ORDER BY topic), '') AS topic_tags FROM p LEFT JOIN tags USING (passage_id) GROUP BY passage_id"),
    "topic_counts": _with(_TAGS, "SELECT topic, count(*) AS n FROM tags GROUP BY topic"),
    "topic_counts_group": _with(_TAGS, "SELECT topic, count(*) AS n FROM tags JOIN p USING (passage_id) WHERE group_id = 'fr' GROUP BY topic"),
    "topic_group_crosstab": _with(_TAGS, """SELECT topic, en, fr, de, es, en + fr + de + es AS total,
      concat_ws(',', CASE WHEN en = 0 THEN 'en' END, CASE WHEN fr = 0 THEN 'fr' END, CASE WHEN de = 0 THEN 'de' END, CASE WHEN es = 0 THEN 'es' END) AS missing FROM (
      SELECT topic, count(*) FILTER (WHERE group_id = 'en') AS en, count(*) FILTER (WHERE group_id = 'fr') AS fr, count(*) FILTER (WHERE group_id = 'de') AS de, count(*) FILTER (WHERE group_id = 'es') AS es
      FROM tags JOIN p USING (passage_id) GROUP BY topic)"""),
    "untagged_count": _with(_TAGS, "SELECT count(*) AS n_passages, count(*) FILTER (WHERE passage_id NOT IN (SELECT passage_id FROM tags)) AS n_untagged FROM p"),
    "group_stats": _with(_TAGS, "SELECT group_id, count(DISTINCT p.passage_id) AS n_passages, count(DISTINCT document_id) AS n_documents, coalesce(string_agg(DISTINCT topic, ',' ORDER BY topic), '') AS topics FROM p LEFT JOIN tags USING (passage_id) GROUP BY group_id"),
    "coverage_imbalance": _with("d cut p g".split(), """, s AS (SELECT group_id, ordinal, count(*) AS n FROM p JOIN g USING (group_id) GROUP BY ALL)
      SELECT round(max(n)::DOUBLE / min(n), 1) AS ratio, arg_min(group_id, (-n, ordinal)) AS best_covered, arg_min(group_id, (n, ordinal)) AS least_covered FROM s HAVING count(*) >= 2 AND max(n)::DOUBLE / min(n) >= 3"""),
    "corpus_meta": _with("d cut p".split(), "SELECT '1.0.0' AS corpus_version, '' AS generated_at, (SELECT count(*) FROM d) AS document_count, (SELECT count(*) FROM p) AS passage_count"),
    "list_documents": _with("d cut p".split(), "SELECT document_id, group_id, title, source_url, checksum, char_count, coalesce(n, 0) AS passage_count FROM d LEFT JOIN (SELECT document_id, count(*) AS n FROM p GROUP BY document_id) USING (document_id) WHERE group_id = 'de'"),
    "list_groups": _with([*_TAGS, "g"], "SELECT g.*, coalesce(n, 0) AS n_passages, coalesce(topics, '') AS topics FROM g LEFT JOIN (SELECT group_id, count(DISTINCT p.passage_id) AS n, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM p LEFT JOIN tags USING (passage_id) GROUP BY group_id) USING (group_id)"),
    "list_sources": _with("d cut p".split(), f"""SELECT document_id, group_id, source_type, CASE WHEN collection = 'src3' THEN 'http://old.example/' || document_id END AS original_url,
      CASE WHEN collection = 'src3' THEN '{ARCHIVED.replace("'", "''")}' END AS archive_note, coalesce(n, 0) AS passage_count FROM d LEFT JOIN (SELECT document_id, count(*) AS n FROM p GROUP BY document_id) USING (document_id)"""),
    "group_profile": _with([*_TAGS, "g"], """SELECT group_id, group_name, (SELECT count(*) FROM p WHERE group_id = 'de') AS n_passages,
      coalesce((SELECT string_agg(topic || '=' || n, ',' ORDER BY topic) FROM (SELECT topic, count(*) AS n FROM tags JOIN p USING (passage_id) WHERE group_id = 'de' GROUP BY topic)), '') AS topic_coverage,
      (SELECT count(*) FROM d WHERE group_id = 'de') AS n_sources FROM g WHERE group_id = 'de'"""),
    "group_sources": _with(["d"], "SELECT document_id, title, source_type, source_url, checksum FROM d WHERE group_id = 'de'"),
    "topic_catalog": _with(_TAGS, f"SELECT topic, ordinal, label, description, keywords, coalesce(n, 0) AS n_passages FROM ({_values((t.id, n, t.label, t.description, ','.join(t.keywords)) for n, t in enumerate(corpus.TOPICS))}) AS x(topic, ordinal, label, description, keywords) LEFT JOIN (SELECT topic, count(*) AS n FROM tags GROUP BY topic) USING (topic)"),
    "blocks": _with("d cut".split(), "SELECT document_id, ord::INTEGER AS ord, trim(line, ' ' || chr(9) || chr(13)) AS text, start::INTEGER AS start, (start + length(line))::INTEGER AS \"end\" FROM cut"),
    "heading_flags": _with("d cut".split(), f"SELECT document_id, ord::INTEGER AS ord, {_HEADING} AS is_heading FROM (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM cut)"),
    "navigation_flags": _with("d cut".split(), "SELECT document_id, ord::INTEGER AS ord, len(regexp_extract_all(replace(trim(line, ' ' || chr(9) || chr(13)), '. ', ' 7 _ '), '[0-9]{1,3}\\s*_\\s*[A-ZÀ-Ý]')) >= 2 AS is_navigation FROM cut"),
    "passage_context": _with("d cut p".split(), """SELECT c.passage_id AS wanted_id, p.passage_id, p.document_id, p.ord, CASE WHEN p.ord = c.ord THEN 'self' WHEN p.ord < c.ord THEN 'before' ELSE 'after' END AS position, p.text
      FROM p JOIN (SELECT passage_id, document_id, ord FROM p) c ON p.document_id = c.document_id AND p.ord BETWEEN c.ord - 1 AND c.ord + 1"""),
    "neighbour_window": _with("d cut p".split(), "SELECT passage_id, ord, string_agg(passage_id, ',') OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM p"),
    "empty_groups": "SELECT 'it' AS group_id, 'IT' AS short_name",
    "document_problems": _with(["d"], "SELECT document_id, 'no checksum' AS problem FROM d WHERE collection = 'src1' UNION ALL SELECT document_id, 'insecure address' FROM d WHERE collection = 'src2'"),
    "chunks": _with(_CHUNKS, """SELECT document_id || '#c' || c.ord AS passage_id, document_id, document_id || '#s' || home AS section_id, c.ord, substr(text, char_start::BIGINT + 1, (char_end - char_start)::BIGINT) AS text,
      char_start::INTEGER AS char_start, char_end::INTEGER AS char_end, heading, group_id, len(regexp_extract_all(substr(text, char_start::BIGINT + 1, (char_end - char_start)::BIGINT), '[0-9]{1,3}\\s*_\\s*[A-ZÀ-Ý]')) >= 2 AS is_navigation
      FROM chunk c JOIN d USING (document_id) JOIN heads h USING (document_id) WHERE h.ord = home"""),
    "sections": _with("d cut lines heads".split(), "SELECT document_id || '#s' || ord AS section_id, document_id, heading, ord FROM heads"),
    "chunk_coverage": _with(_CHUNKS, """SELECT document_id, n_chars, covered, ratio, ratio < 0.95 AS is_low FROM (SELECT document_id, char_count::BIGINT AS n_chars, coalesce(covered, 0)::BIGINT AS covered, coalesce(covered, 0)::DOUBLE / nullif(char_count, 0) AS ratio
      FROM d LEFT JOIN (SELECT document_id, sum(char_end - char_start) AS covered FROM chunk GROUP BY document_id) USING (document_id))"""),
    "chunk_summary": _with(_CHUNKS, """SELECT document_id, n_sections, coalesce(n_passages, 0) AS n_passages, avg_chars, coalesce(n_short, 0) AS n_short
      FROM (SELECT document_id, count(*) AS n_sections FROM heads GROUP BY document_id) LEFT JOIN (SELECT document_id, count(*) AS n_passages, avg(char_end - char_start) AS avg_chars, count(*) FILTER (WHERE char_end - char_start < 120) AS n_short FROM chunk GROUP BY document_id) USING (document_id)"""),
    "chunk_search": _with([*_CHUNKS, *"p w v post len stats q qw qv qt found idf hit kww kwv kw kwn kwm tags g".split()], _ranking(5) + """
      SELECT query_id, rank, passage_id, score, group_name, group_id, representative, p.text AS quote, heading, coalesce(topic_tags, '') AS topic_tags, title AS document_title, source_url, source_type,
        concat_ws(' — ', short_name || ' (' || representative || ')', nullif(title, ''), CASE WHEN heading <> '' THEN '« ' || trim(regexp_replace(heading, '\\s+', ' ', 'g')) || ' »' END, '2022', source_url) AS citation
      FROM (SELECT query_id, rank, passage_id, round(score, 3) AS score FROM r) JOIN p USING (passage_id) JOIN (SELECT document_id, title, source_url, source_type FROM d) USING (document_id) JOIN g USING (group_id)
      LEFT JOIN (SELECT passage_id, string_agg(topic, ',' ORDER BY topic) AS topic_tags FROM tags GROUP BY passage_id) USING (passage_id)""", q=_queries(),
      p="""SELECT document_id || '#c' || c.ord AS passage_id, document_id, group_id, c.ord, substr(text, char_start::BIGINT + 1, (char_end - char_start)::BIGINT) AS text, heading
        FROM chunk c JOIN d USING (document_id) JOIN heads h USING (document_id) WHERE h.ord = home"""),
    "slice_check": _with("d cut p".split(), """SELECT passage_id, p.document_id FROM p JOIN (SELECT document_id || ':' || ord AS passage_id, start, length(line) AS size FROM cut) USING (passage_id)
      JOIN (SELECT document_id, d.text AS whole, collection FROM d) w USING (document_id)
      WHERE p.text <> substr(whole, start::BIGINT + CASE WHEN collection = 'src1' THEN 2 ELSE 1 END, size)"""),
    "referential_check": _with("d cut p".split(), """SELECT passage_id, 'document' AS missing FROM p WHERE document_id IN (SELECT document_id FROM d WHERE collection = 'src1')
      UNION ALL SELECT passage_id, 'section' FROM p WHERE document_id IN (SELECT document_id FROM d WHERE collection IN ('src1', 'src2'))"""),
    "normalize_lines": _with("d cut".split(), f"SELECT document_id, ord::INTEGER AS ord, {_normalized('trim(line, chr(32) || chr(9) || chr(13))')} AS line FROM cut"),
    "page_ngrams": _with("d raw_line line gram".split(), "SELECT document_id, ngram, n_pages FROM gram WHERE n_pages > 1"),
    "boilerplate": _with(_HEADERS, "SELECT document_id, array_to_string(furniture, '|') AS furniture FROM header"),
    "paged_text": _with([*_HEADERS, *"clean token joined kept flag paragraph".split()], """SELECT d.document_id, coalesce(string_agg(paragraph.text, chr(10) ORDER BY page, no) FILTER (WHERE paragraph.text <> ''), '') || chr(10) AS text
      FROM d LEFT JOIN paragraph USING (document_id) GROUP BY d.document_id"""),
    "checksums": "SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes, strlen(html) >= 2048 AS has_format FROM pages",
    "alias_resolution": _with(["d"], f""", x AS (SELECT *, strip_accents(lower(trim(label))) AS key FROM (SELECT unnest([' ' || upper(group_id) || ' ',
        CASE group_id WHEN 'fr' THEN 'FRANCAIS' WHEN 'de' THEN ' Allemand' WHEN 'es' THEN 'espanol ' ELSE 'Anglais' END, collection]) AS label FROM d)),
      a AS (SELECT strip_accents(lower(name)) AS key, arg_min(group_id, (kind, n)) AS group_id FROM ({_values([(g.id, n, 0, g.id) for n, g in enumerate(corpus.GROUPS)] + [(g.id, n, 1, x) for n, g in enumerate(corpus.GROUPS) for x in g.aliases])}) AS y(group_id, n, kind, name) GROUP BY 1)
      SELECT label, group_id FROM x LEFT JOIN a USING (key)"""),
    "citations_of_documents": _with("d g".split(), """SELECT document_id, concat_ws(' — ', short_name || ' (' || representative || ')', nullif(title, ''),
      CASE WHEN collection <> 'src5' AND title <> '' THEN '« ' || trim(regexp_replace(title, '\\s+', ' ', 'g')) || ' »' END, '2022', source_url) AS citation FROM d JOIN g USING (group_id)"""),
    "truncated": _with(["d"], """SELECT document_id, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(CASE WHEN place > 48 THEN left(h, place) ELSE h END, ' ' || chr(10)) || '…' END AS short
      FROM (SELECT document_id, text, left(text, 80) AS h, length(left(text, 80)) - position(' ' IN reverse(left(text, 80))) AS place FROM d)"""),
}
