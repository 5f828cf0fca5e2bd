"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from pagemill.functions import textsem as T
from pagemill.operators.layout import ADVANCE, LEFT, PITCH, SIZE
from pagemill.plans.queries import ASKED
from pagemill.sources import markup


def _s(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_s, words)) + ")"


def _trim(e: str) -> str:
    return f"regexp_replace({e}, {_s(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def _key(e: str) -> str:
    inner = rf"regexp_replace(regexp_replace(lower({e}), '\b[ivxlcdm]{{1,7}}\b', '#', 'g'), '[0-9]+', '#', 'g')"
    return rf"regexp_replace({inner}, '[^a-z#\p{{L}}]+', '', 'g')"


def _heading(e: str) -> str:
    words = f"list_filter(string_split_regex({e}, {_s(T.WS + '+')}), lambda w: w <> '')"
    letters = rf"list_filter({words}, lambda w: regexp_matches(w, '^\p{{L}}'))"
    lower = rf"list_filter({words}, lambda w: regexp_matches(w, '^\p{{Ll}}'))"
    several = _s(r'[.!?]["”’]?\s+\p{Lu}')
    return (
        f"(len({words}) <= 12 AND length({e}) <= 80 AND NOT regexp_matches({e}, '[-–—,;]$')"
        f" AND NOT (len({letters}) > 4 AND len({lower}) / len({letters}) > 0.5)"
        f" AND NOT (regexp_matches({e}, {several}) AND len({words}) > 6))"
    )


_RAW = "SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents"

LINES = f"""lines AS (
  SELECT source, doc_id, line_no, {_trim('raw')} AS text, {LEFT} + {ADVANCE} * length(regexp_extract(raw, '^( *)', 1)) AS x,
    {PITCH} * line_no AS y, {ADVANCE} * length({_trim('raw')}) AS w
  FROM ({_RAW}) WHERE {_trim('raw')} <> '')"""

EDGES = f"""edges AS (
  SELECT *, {_key('text')} AS key FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS b FROM lines)
  WHERE a <= 2 OR b <= 2),
running AS (
  SELECT source, key, count(DISTINCT doc_id) AS pages,
    count(DISTINCT doc_id) >= greatest(3, ceil(0.15 * any_value(of_pages))) AS running
  FROM edges JOIN (SELECT source, count(DISTINCT doc_id) AS of_pages FROM lines GROUP BY source) USING (source)
  WHERE length(key) >= 2 GROUP BY source, key)"""

_PIECE = r"""CASE WHEN after IS NULL THEN text
    WHEN regexp_matches(text, '\p{L}-$') AND regexp_matches(after, '^\p{Ll}') THEN substr(text, 1, length(text) - 1)
    WHEN suffix(text, chr(173)) THEN substr(text, 1, length(text) - 1)
    WHEN regexp_matches(text, '[-–—/]$') AND NOT regexp_matches(text, '\s[-–—]$') THEN text
    ELSE text || ' ' END"""

BLOCKS = f"""{LINES},
classed AS (
  SELECT lines.*, width, CASE WHEN regexp_matches(text, {_s(T.SCENE_BREAK)}) AND regexp_matches(text, {_s(T.ORNAMENT)}) THEN 'hr'
    WHEN {_heading('text')} AND regexp_matches(text, {_s(T.CHAPTER)}) AND length(text) < 70 THEN 'h' ELSE 'p' END AS t
  FROM lines JOIN (
    SELECT doc_id, list_sort(list(w))[least(count(*), floor(count(*) * 0.8) + 1)::INT] AS width FROM lines GROUP BY doc_id) USING (doc_id)),
marked AS (
  SELECT *, CASE WHEN pt IS NULL OR pt <> t OR t <> 'p' OR y - py > {1.45 * PITCH}
    OR (regexp_matches(pw_text, {_s(T.ENDS_SENTENCE)}) AND ((x > {LEFT + 0.8 * SIZE} AND x - {LEFT} < 0.3 * width) OR pw < 0.8 * width)) THEN 1 ELSE 0 END AS new
  FROM (SELECT *, lag(t) OVER o AS pt, lag(text) OVER o AS pw_text, lag(y) OVER o AS py, lag(w) OVER o AS pw FROM classed
    WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))),
islands AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS block FROM marked),
pieces AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, block ORDER BY line_no) AS after FROM islands),
blocks AS (
  SELECT doc_id, block, t, CASE WHEN t = 'hr' THEN '' ELSE string_agg({_PIECE}, '' ORDER BY line_no) END AS text FROM pieces GROUP BY doc_id, block, t),
indexed AS (
  SELECT *, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block))::BIGINT - length(text) - 1 AS chars_before,
    (sum(length(text) + 1) OVER (PARTITION BY doc_id))::BIGINT AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks)"""

RANKS = r"""words AS (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents WHERE lang = 'en'),
ranks AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM (
    SELECT word, count(*) AS n FROM words WHERE regexp_matches(word, '^[a-z]+$') AND (length(word) > 1 OR word IN ('a', 'i'))
    GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 60000))"""


def _cores(least: int, where: str = "true") -> str:
    return rf"""cores AS (
  SELECT doc_id, lower(core) AS word FROM (
    SELECT doc_id, regexp_replace(tok, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') AS core FROM (
      SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), {_s(T.WS + '+')})) AS tok FROM documents WHERE {where}))
  WHERE length(core) >= {least} AND regexp_matches(core, '^\p{{L}}+$'))"""


_SPACED = rf"""list_filter(string_split(text, chr(10)), lambda l:
    len(list_filter(string_split_regex(l, {_s(T.WS + '+')}), lambda t: t <> '')) >= 3
    AND len(list_filter(string_split_regex(l, {_s(T.WS + '+')}), lambda t: regexp_matches(t, '^\p{{L}}{{1,2}}[:,.]?$'))) >= 3
    AND len(list_filter(string_split_regex(l, {_s(T.WS + '+')}), lambda t: regexp_matches(t, '^\p{{L}}{{1,2}}[:,.]?$')))
      / len(list_filter(string_split_regex(l, {_s(T.WS + '+')}), lambda t: t <> '')) >= 0.4)"""

_JUNK = _s(r"""[\p{L}\p{N}.,;:!?'"’“”()\-–— """ + "\n]")

QUALITY = rf"""{RANKS}, {_cores(3)},
shape AS (
  SELECT doc_id, source, len({_SPACED}) AS letter_spaced, length(regexp_replace(text, '[ ' || chr(10) || ']', '', 'g')) AS chars,
    length(regexp_replace(text, {_JUNK}, '', 'g')) AS junk FROM documents),
known AS (SELECT doc_id, count(*) AS words, count(*) - count(rank) AS unknown FROM cores LEFT JOIN ranks USING (word) GROUP BY doc_id),
quality AS (
  SELECT doc_id, source, coalesce(words, 0) AS words, CASE WHEN words > 0 THEN unknown / words ELSE 0.0 END AS unknown_ratio, letter_spaced::BIGINT AS letter_spaced,
    CASE WHEN chars > 0 THEN junk / chars ELSE 0.0 END AS junk_ratio FROM shape LEFT JOIN known USING (doc_id))"""

POOR = "(unknown_ratio > 0.06 OR letter_spaced >= 2 OR junk_ratio > 0.02)"

BOOKS = r"""books AS (
  SELECT doc_id AS book_id, trim(regexp_replace(text, '[\n\r]', ' ', 'g'), ' ') AS title,
    CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE 'Author ' || lang || (doc_id % 5) END AS author, source || '.pdf' AS file_name, quality = 1 AS favorite,
    [source, lang] AS collections, CASE WHEN toxic = 1 THEN 'to-read' END AS reading_status, least(1.0, n_chars / 5000) AS progress, doc_id % 3 AS last_read, n_chars AS added
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _fold(e: str) -> str:
    return f"lower(strip_accents({e}))"


HITS = f"""rows AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents),
asked AS (SELECT unnest([{', '.join(_s(q.strip()) for q in ASKED)}]) AS query),
pieces AS (
  SELECT doc_id, block, text, query, length({_fold('query')}) AS k, string_split({_fold('rows.text')}, {_fold('query')}) AS p FROM rows, asked
  WHERE contains({_fold('rows.text')}, {_fold('query')})),
found AS (SELECT doc_id, block, text, query, k, p, unnest(generate_series(1, len(p) - 1)) AS j FROM pieces),
hits AS (
  SELECT doc_id, block, text, query, least(pos, length(text)) AS start, least(pos + length(query), length(text)) AS "end" FROM (
    SELECT *, (list_sum(list_transform(p[1:j], lambda x: length(x))) + (j - 1) * k)::INT AS pos FROM found)),
limited AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY block, start) AS k FROM hits)"""

_WORD = r"[\p{L}\p{N}'’-]"

ACTIVITY = """activity AS (
  SELECT user_id, ts, event_id, (floor(value * 100) % 30000)::BIGINT AS position FROM events),
gaps AS (
  SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER o) AS gap, position - lag(position) OVER o AS move FROM activity WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _days(idle: int) -> str:
    return f"""days AS (
  SELECT user_id, ts::DATE AS day, coalesce(sum(gap) FILTER (gap < {idle}::BIGINT * 1000000), 0)::BIGINT AS micros,
    coalesce(sum(move) FILTER (move > 0 AND move < 20000), 0)::BIGINT AS chars FROM gaps GROUP BY user_id, ts::DATE)"""


def _half_up(e: str) -> str:
    return f"floor({e} + 0.5)::BIGINT"


def _luminance(e: str) -> str:
    def part(at, weight):
        v = f"(('0x' || substr({e}, {at}, 2))::INT / 255)"
        return f"{weight} * CASE WHEN {v} <= 0.03928 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END"

    return f"({part(1, 0.2126)} + {part(3, 0.7152)} + {part(5, 0.0722)})"


def _sentences(keys: str, of: str = "documents") -> str:
    """Words of the texts by ``keys`` with their places b and sentences."""
    abbreviations, closers, opener = _list(T.ABBREVIATIONS), r"""["'”’»)\]]""", r"""^[\p{Lu}\p{N}"'“‘«(\\\[]"""
    return rf"""cut AS (
  SELECT {keys}, text, length(text) - length(regexp_replace(text, {_s(f'^{T.WS}+')}, '')) AS ahead, {_trim('text')} AS t FROM {of}),
words AS (
  SELECT {keys}, ahead, unnest(string_split_regex(t, {_s(T.WS + '+')})) AS w, generate_subscripts(string_split_regex(t, {_s(T.WS + '+')}), 1) AS i,
    unnest(list_append(regexp_extract_all(t, {_s(T.WS + '+')}), '')) AS gap FROM cut),
seen AS (
  SELECT *, ahead + coalesce(sum(length(w) + length(gap)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
    lead(w) OVER (PARTITION BY {keys} ORDER BY i) AS nxt, regexp_extract(w, {_s(r'([.!?…]+)' + closers + '*$')}, 1) AS stop,
    regexp_extract(w, {_s(r'([\p{L}.]*?)[.!?…]+' + closers + '*$')}, 1) AS before FROM words WHERE w <> ''),
ends AS (
  SELECT *, coalesce(stop <> '' AND regexp_matches(nxt, {_s(opener)}) AND NOT (stop[1] = '.' AND (lower(replace(before, '.', '')) IN {abbreviations}
    OR regexp_matches(lower(replace(before, '.', '')), '^\p{{L}}$') OR regexp_matches(before, '^(\p{{L}}\.)+\p{{L}}$'))), false)::INT AS e FROM seen),
numbered AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_no FROM ends)"""


def _printed(book: str) -> str:
    """Documents as printed pages, their body sizes, running lines and what is left."""
    page = "p" if book == "doc_id" else "doc_id * 1000000 + p"
    return rf"""par AS (
  SELECT doc_id, source, par, w, len(w) AS n, len(w) <= 6 AS short, (doc_id + par) % 5 AS v FROM (
    SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS par,
      list_filter(string_split_regex(unnest(string_split(coalesce(text, ''), chr(10))), {_s(T.WS + '+')}), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0),
cut AS (SELECT *, array_to_string(w[9 * j + 1:9 * j + 9], ' ') AS said FROM (SELECT *, unnest(generate_series(0, (n - 1) // 9)) AS j FROM par)),
put AS (
  SELECT doc_id, source, par, j, short, v, CASE WHEN short AND v = 1 AND regexp_matches(said, '^[A-Za-z ,.]+$') THEN upper(said) ELSE said END AS said,
    (coalesce(sum(CASE WHEN short THEN 3 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY par, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + short::INT)::BIGINT AS slot,
    CASE WHEN short AND v = 0 THEN 16.0 ELSE 11.0 END::DOUBLE AS size FROM cut),
body_ AS (
  SELECT doc_id, source, slot // 36 AS p, slot % 36 + 1 AS line_no, said AS text,
    CASE WHEN short AND v <= 2 THEN 50 + (300 - size * 0.5::DOUBLE * length(said)) / 2 WHEN v >= 3 AND j = 0 THEN 62 ELSE 50 END::DOUBLE AS x,
    (60 + 15 * (slot % 36))::DOUBLE AS y, size * 0.5::DOUBLE * length(said) AS w, size FROM put),
sides AS (SELECT DISTINCT doc_id, source, p FROM body_),
printed AS (
  SELECT {book} AS book, {page} AS page, CASE WHEN p % 7 = 6 THEN 'scan' ELSE 'text' END AS origin, line_no, text, x, y, w, size FROM (
    SELECT * FROM body_ UNION ALL SELECT doc_id, source, p, 0, CASE WHEN p % 2 = 0 THEN 'The book of ' || source ELSE 'Leaf of ' || doc_id END, 150.0, 30.0, 100.0, 9.0 FROM sides
    UNION ALL SELECT doc_id, source, p, 37, '- ' || (p + 1) || ' -', 195.0, 620.0, 10.0, 9.0 FROM sides)),
{_body_sizes("printed", "pbody")},
edge AS (
  SELECT * FROM (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY book, page) AS n, {_key('text')} AS key FROM printed WINDOW o AS (PARTITION BY book, page ORDER BY line_no))
  WHERE (i < 2 OR i >= n - 2) AND (y < 0.15::DOUBLE * 650 OR y + size > 0.85::DOUBLE * 650)),
often AS (SELECT book, key, count(DISTINCT page) AS pages FROM edge WHERE length(key) >= 2 GROUP BY book, key),
enough AS (SELECT book, greatest(3, ceil(count(DISTINCT page) * 0.15::DOUBLE)) AS enough FROM printed GROUP BY book),
gone AS (
  SELECT book, page, line_no FROM edge JOIN pbody USING (book, origin) JOIN enough USING (book) LEFT JOIN often USING (book, key)
  WHERE regexp_matches(text, {_s(T.PAGE_NUMBER)}) OR (size <= 1.15::DOUBLE * body AND (coalesce(pages >= enough, false) OR (size < 0.92::DOUBLE * body
    AND (coalesce(pages >= 2, false) OR (i = 0 AND y < 0.12::DOUBLE * 650 AND length(text) < 80 AND NOT regexp_matches(text, '[.!?]$'))))))),
kept AS (SELECT * FROM printed ANTI JOIN gone USING (book, page, line_no))"""


def _body_sizes(of: str, name: str) -> str:
    return f"""{name} AS (
  SELECT book, origin, coalesce(nullif(k, 0), 10.0::DOUBLE) AS body FROM (
    SELECT book, origin, floor(size / 0.5::DOUBLE + 0.5) * 0.5::DOUBLE AS k, sum(length(text)) AS n, min({{'p': page, 'l': line_no}}) AS f FROM {of} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY book, origin ORDER BY n DESC, f) = 1)"""


def _rank(e: str, p: float) -> str:
    return f"list_sort(list({e}))[least(count({e}), floor(count({e}) * {p}::DOUBLE) + 1)::INT]"


def _page_stats(of: str) -> str:
    """``stats``: the measures of the pages of ``of``, from the page's own lines and from all of its origin."""

    def measures(by: str) -> str:
        own = "CASE WHEN near THEN w END"
        return f"""SELECT {by}, count(*) FILTER (near) AS n, any_value(body) AS body, coalesce(nullif(any_value(m), 0), {_rank('x', 0.1)}) AS l, coalesce(nullif({_rank(own, 0.8)}, 0), 280.0) AS w,
    coalesce(nullif({_rank('d', 0.5)}, 0), any_value(body) * 1.3::DOUBLE) AS s, {_rank('x + w', 0.9)} AS e FROM {{rows}} LEFT JOIN {{mode}} USING ({by}) GROUP BY {by}"""

    def mode(by: str) -> str:
        return f"""SELECT {by}, k AS m FROM (SELECT {by}, floor(x / 2 + 0.5) * 2 AS k, count(*) AS c, min({{'p': page, 'l': line_no}}) AS f FROM near WHERE near GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY c DESC, f) = 1"""

    def steps(by: str) -> str:
        return f"""SELECT *, CASE WHEN dy > 0 THEN dy END AS d FROM (
    SELECT *, CASE WHEN near THEN y - lag(y) OVER (PARTITION BY {by}, near ORDER BY page, line_no) END AS dy FROM near)"""

    page, book = "book, origin, page", "book, origin"
    return f"""{_body_sizes(of, "sbody")},
near AS (SELECT t.*, body, abs(size - body) <= 0.15::DOUBLE * body AS near FROM {of} t JOIN sbody USING (book, origin)),
prow AS ({steps(page)}), brow AS ({steps(book)}), pmode AS ({mode(page)}), bmode AS ({mode(book)}),
pm AS ({measures(page).format(rows="prow", mode="pmode")}), bm AS ({measures(book).format(rows="brow", mode="bmode")}),
stats AS (
  SELECT book, origin, page, body, l AS "left", w AS width, s AS spacing, (l + greatest(l + w, e)) / 2 AS center FROM (
    SELECT p.book, p.origin, p.page, p.body, CASE WHEN p.n < 4 THEN b.l ELSE p.l END AS l, CASE WHEN p.n < 4 THEN b.w ELSE p.w END AS w,
      CASE WHEN p.n < 4 THEN b.s ELSE p.s END AS s, CASE WHEN p.n < 4 THEN b.e ELSE p.e END AS e FROM pm p JOIN bm b USING (book, origin)))"""


def _book_blocks() -> str:
    letters = r"regexp_replace(text, '[^\p{L}]', '', 'g')"
    capital = r"regexp_matches(text, '^\p{Lu}')"
    any_letter = r"regexp_matches(text, '\p{L}|[0-9]')"
    chapter = f"regexp_matches(text, {_s(T.CHAPTER)})"
    middle = "abs(x + w / 2 - center) < 0.08::DOUBLE * width"
    small = "w < 0.8::DOUBLE * width"
    heading = f"""({_heading('text')} AND NOT (w > 0.9::DOUBLE * width AND abs(x - "left") < 2 * body AND NOT {chapter}) AND (
      (size >= 1.2::DOUBLE * body AND length(text) < 100 AND {any_letter})
      OR ({chapter} AND length(text) < 70 AND (({middle} AND {small}) OR above > 1.8::DOUBLE * spacing OR size > 1.05::DOUBLE * body))
      OR (regexp_matches(text, {_s(T.NUMERAL)}) AND (({middle} AND {small}) OR size >= 1.2::DOUBLE * body) AND below > 1.3::DOUBLE * spacing)
      OR ({middle} AND w < 0.97::DOUBLE * width AND length({letters}) >= 4 AND {letters} = upper({letters}) AND len(string_split_regex(text, {_s(T.WS + '+')})) <= 8)
      OR ({middle} AND {small} AND length(text) < 50 AND above > 2 * spacing AND below > 1.4::DOUBLE * spacing AND NOT regexp_matches(text, {_s(T.ENDS_SENTENCE)}) AND {capital})))"""
    return rf"""{_printed("doc_id")}, {_page_stats("kept")},
placed AS (
  SELECT k.*, body, "left", width, spacing, center, row_number() OVER o AS pos, coalesce(y - lag(y) OVER o, 3 * spacing) AS above, coalesce(lead(y) OVER o - y, 3 * spacing) AS below
  FROM kept k JOIN stats USING (book, origin, page) WINDOW o AS (PARTITION BY book, page ORDER BY y, x, line_no)),
told AS (SELECT *, CASE WHEN regexp_matches(text, {_s(T.SCENE_BREAK)}) AND regexp_matches(text, {_s(T.ORNAMENT)}) THEN 'hr' WHEN {heading} THEN 'h' ELSE 'p' END AS t FROM placed),
seen AS (
  SELECT *, lag(t) OVER o AS wt, lag(page) OVER o AS wp, lag(text) OVER o AS wx, lag(w) OVER o AS ww, lag(width) OVER o AS wwidth FROM told WINDOW o AS (PARTITION BY book ORDER BY page, pos)),
fresh AS (
  SELECT *, NOT coalesce(wt = t AND CASE t WHEN 'h' THEN wp = page WHEN 'p' THEN NOT ((wp = page AND above > 1.45::DOUBLE * spacing)
    OR (regexp_matches(wx, {_s(T.ENDS_SENTENCE)}) AND ((x > "left" + 0.8::DOUBLE * body AND x - "left" < 0.3::DOUBLE * width) OR ww < 0.8::DOUBLE * wwidth))) ELSE false END, false) AS new FROM seen),
isl AS (SELECT *, sum(new::INT) OVER (PARTITION BY book ORDER BY page, pos) AS island FROM fresh),
nexts AS (SELECT *, lead(text) OVER (PARTITION BY book, island ORDER BY page, pos) AS after, row_number() OVER (PARTITION BY book, island ORDER BY page, pos) AS i FROM isl),
plain AS (SELECT book, island, 0 AS k, min(page) AS page, t, CASE WHEN t = 'hr' THEN '' ELSE string_agg({_PIECE}, '' ORDER BY page, pos) END AS text FROM nexts WHERE t <> 'h' GROUP BY book, island, t),
heads AS (
  SELECT book, island, i, page, y, text, 0 AS k, false AS done FROM nexts WHERE t = 'h' AND i = 1
  UNION ALL
  SELECT n.book, n.island, n.i, n.page, n.y, CASE WHEN fits THEN regexp_replace(h.text || ': ' || n.text, ':\s*:', ':') ELSE n.text END, CASE WHEN fits THEN h.k ELSE h.k + 1 END, false
  FROM (SELECT h.*, n.y - h.y < 4 * n.spacing AND length(h.text) + length(n.text) < 100 AS fits FROM heads h JOIN nexts n ON n.book = h.book AND n.island = h.island AND n.i = h.i + 1) h
  JOIN nexts n ON n.book = h.book AND n.island = h.island AND n.i = h.i + 1),
merged AS (SELECT book, island, k, page, 'h' AS t, last(text ORDER BY i) AS text FROM heads GROUP BY book, island, k, page),
book_blocks AS (
  SELECT book AS doc_id, row_number() OVER (PARTITION BY book ORDER BY island, k) - 1 AS block, page, t, text FROM (SELECT * FROM plain UNION ALL SELECT book, island, k, page, t, text FROM merged))"""


def _inline() -> str:
    """``done``: stretches of inline content with their text, html and spans."""
    names, shown = ("MAP {" + ", ".join(f"{_s(k)}: {_s(v)}" for k, v in m.items()) + "}" for m in (markup.NAMED, markup.INLINE))
    inline, esc = _list([*markup.INLINE, "a"]), lambda e: f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

    def decoded(e: str) -> str:
        ten = "chr(TRY_CAST(p[3:length(p) - 1] AS INT))"
        return f"""array_to_string(list_transform(regexp_extract_all({e}, {_s(markup.ENTITY)}), lambda p: CASE WHEN p[1:3] IN ('&#x', '&#X') THEN chr(('0x' || p[4:length(p) - 1])::INT)
      WHEN p[1:2] = '&#' AND length(p) > 3 THEN {ten} WHEN p[1:1] = '&' AND length(p) > 2 THEN coalesce(({names})[p], p) ELSE p END), '')"""

    href = decoded(f"regexp_extract(tok, {_s(r'(?is)[\s]href\s*=\s*' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, 1)")
    steps = "array_to_string(list_filter(string_split(url_decode(replace(href, '+', '%2B')), '/'), lambda x: x NOT IN ('', '.')), '/')"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return rf"""tok AS (
  SELECT page_id, unnest(regexp_extract_all(html, {_s(markup.TOKEN)})) AS tok, generate_subscripts(regexp_extract_all(html, {_s(markup.TOKEN)}), 1) AS i FROM pages),
named AS (
  SELECT *, nullif(lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:-]*)[^>]*>$', 1)), '') AS name, tok[1:2] = '</' AS ends FROM tok
  WHERE NOT regexp_matches(tok, '(?is)^<([!?]|(script|style)\b)')),
vis AS (
  SELECT * FROM (SELECT *, count(*) FILTER (name IN {_list(markup.BLOCKS)}) OVER o AS run, count(*) FILTER (name = 'head' AND NOT ends) OVER o - count(*) FILTER (name = 'head' AND ends) OVER o AS deep
    FROM named WINDOW o AS (PARTITION BY page_id ORDER BY i)) WHERE deep = 0 AND coalesce(name, '') <> 'head'),
tags AS (
  SELECT * FROM (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY page_id, run, name ORDER BY i {upto}), 0)) AS low FROM (
    SELECT *, sum(CASE WHEN ends THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, run, name ORDER BY i) AS s FROM vis WHERE name IN {inline})) WHERE s >= low),
pairs AS (
  SELECT *, lead(i) OVER (PARTITION BY page_id, run, name, level ORDER BY i) AS closer FROM (SELECT *, s - low + ends::INT AS level FROM tags)),
starts AS (SELECT page_id, run, i, closer, name, CASE WHEN name = 'a' THEN 'a' ELSE ({shown})[name] END AS tag, {href} AS href FROM pairs WHERE NOT ends),
put AS (
  SELECT *, CASE WHEN name <> 'a' THEN '<' || tag || '>' WHEN href = '' THEN NULL WHEN regexp_matches(href, '(?i)^https?:') THEN '<a data-ext="' || {esc('href')} || '">'
    WHEN NOT regexp_matches(href, '(?i)^[a-z]+:') THEN '<a data-href="' || {esc("(CASE WHEN href[1:1] = '/' THEN '' ELSE 'OEBPS/text/' END || " + steps + ")")} || '">' END AS open FROM starts),
good AS (SELECT * FROM put WHERE open IS NOT NULL),
parts AS (
  SELECT page_id, run, i AS pos, 0 AS k, i AS start, NULL AS raw, open AS tag FROM good
  UNION ALL SELECT page_id, run, coalesce(closer, (1::BIGINT << 40) - i), 0, i, NULL, '</' || tag || '>' FROM good
  UNION ALL SELECT page_id, run, i, 0, NULL, ' ', NULL FROM vis WHERE name = 'br' UNION ALL SELECT page_id, run, i, 1, NULL, NULL, '<br>' FROM vis WHERE name = 'br'
  UNION ALL SELECT page_id, run, i, 0, NULL, {decoded('tok')}, NULL FROM vis WHERE name IS NULL),
flat AS (SELECT *, regexp_replace(regexp_replace(raw, '\x{{A0}}*[ \t\n\r\f\x0B][ \t\n\r\f\x0B\x{{A0}}]*', ' ', 'g'), '\x{{A0}}+', chr(160), 'g') AS flat FROM parts),
seen AS (
  SELECT *, coalesce(last_value(CASE WHEN flat <> '' THEN suffix(flat, ' ') END IGNORE NULLS) OVER (PARTITION BY page_id, run ORDER BY pos, k {upto}), true) AS spaced,
    coalesce(sum((replace(flat, ' ', '') <> '')::INT) OVER (PARTITION BY page_id, run ORDER BY pos, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS behind FROM flat),
told AS (
  SELECT *, CASE WHEN behind = 0 THEN rtrim(l, ' ') ELSE l END AS said FROM (SELECT *, CASE WHEN spaced THEN ltrim(flat, ' ') ELSE flat END AS l FROM seen)),
placed AS (SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY page_id, run ORDER BY pos, k {upto}), 0)::INT AS place FROM told),
ranges AS (
  SELECT page_id, run, string_agg(tag || ' ' || a || ' ' || b, ',' ORDER BY start) AS spans FROM (
    SELECT page_id, run, start, regexp_extract(any_value(tag), '^</?([a-z]+)', 1) AS tag, min(place) AS a, max(place) AS b FROM placed WHERE start IS NOT NULL GROUP BY page_id, run, start) GROUP BY page_id, run),
done AS (
  SELECT page_id, run, string_agg(said, '' ORDER BY pos, k) AS text, string_agg(coalesce(tag, {esc('said')}), '' ORDER BY pos, k) AS html FROM placed GROUP BY page_id, run)"""


def _nav() -> str:
    """``spine``: stretches of web pages as blocks of books; ``toc``: the links of their navigations that lead somewhere."""
    return rf"""{_inline()},
spine AS (
  SELECT page_id // 10 AS book, block, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id, block) - 1 AS nr, 'OEBPS/ch' || page_id || '.xhtml' AS path, text, length(text) < 40 AS head
  FROM (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY run) - 1 AS block FROM done WHERE {_trim('text')} <> '')),
targets AS (
  SELECT book, path || '#p' || block AS target, max(nr) AS nr FROM spine WHERE block % 2 = 0 GROUP BY ALL UNION ALL SELECT book, path, min(nr) FROM spine GROUP BY ALL),
links AS (
  SELECT page_id // 10 AS book, page_id, unnest(l) AS label, generate_subscripts(l, 1) AS ord FROM (
    SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1) AS l FROM pages)),
led AS (
  SELECT *, 'OEBPS/ch' || (book * 10 + ord * 3 % 12) || '.xhtml' AS file, CASE WHEN ord % 3 > 0 THEN '#p' || (ord * 2) ELSE '' END AS frag, least(2, ord % 4) AS level FROM links),
toc AS (
  SELECT l.book, row_number() OVER (PARTITION BY l.book ORDER BY page_id, ord) - 1 AS toc_no, {_trim("replace(label, '&amp;', '&')")} AS title, coalesce(e.nr, f.nr) AS block, level
  FROM led l LEFT JOIN targets e ON e.book = l.book AND e.target = file || frag LEFT JOIN targets f ON f.book = l.book AND f.target = file WHERE coalesce(e.nr, f.nr) IS NOT NULL)"""


def _share(e: str) -> str:
    bare = f"regexp_replace({e}, {_s(T.WS)}, '', 'g')"
    return rf"(CASE WHEN length({bare}) > 0 THEN length(regexp_replace({bare}, '[^\p{{L}}\p{{N}}]', '', 'g')) / length({bare}) ELSE 0 END)"


def _mended() -> str:
    """``mended``: damaged pages with the words put together that a hyphen parts over two lines."""
    return rf"""{RANKS}, {_printed("doc_id")},
dealt AS (
  SELECT *, lag(rest) OVER o AS got FROM (
    SELECT *, CASE WHEN line_no % 3 = 0 AND regexp_matches(text, ' \p{{Ll}}{{6,}}$') AND lead(line_no) OVER o IS NOT NULL THEN regexp_extract(text, ' (\p{{Ll}}{{6,}})$', 1)[4:] END AS rest
    FROM (SELECT p.* FROM printed p SEMI JOIN (SELECT doc_id AS book FROM documents WHERE lang = 'en') USING (book) WHERE line_no BETWEEN 1 AND 36) WINDOW o AS (PARTITION BY book, page ORDER BY line_no))
  WINDOW o AS (PARTITION BY book, page ORDER BY line_no)),
dmg AS (
  SELECT book, page, line_no, concat_ws(' ', got, CASE WHEN text = upper(text) THEN regexp_replace(regexp_replace(text, '([A-Z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z])', '\1 \2', 'g')
    WHEN rest IS NOT NULL THEN substr(text, 1, length(text) - length(rest)) || '-' ELSE text END) AS text FROM dealt),
near AS (
  SELECT *, regexp_extract(text, '(\p{{L}}+)[-–—]$', 1) AS head, coalesce(regexp_extract(after, '^(\p{{Ll}}+)', 1), '') AS tail, row_number() OVER (PARTITION BY book, page ORDER BY line_no) AS i
  FROM (SELECT *, lead(text) OVER (PARTITION BY book, page ORDER BY line_no) AS after FROM dmg)),
cans AS (SELECT near.*, ranks.word IS NOT NULL AS can FROM near LEFT JOIN ranks ON head <> '' AND tail <> '' AND ranks.word = lower(head || tail)),
walk AS (
  SELECT book, page, i, can AS up FROM cans WHERE i = 1
  UNION ALL SELECT c.book, c.page, c.i, c.can AND NOT (w.up AND NOT regexp_matches(c.text, '\s')) FROM walk w JOIN cans c ON c.book = w.book AND c.page = w.page AND c.i = w.i + 1),
took AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY book, page ORDER BY i), false) AS taken FROM cans JOIN walk USING (book, page, i)),
cutoff AS (SELECT *, CASE WHEN taken THEN regexp_replace(text, '^\S+\s*', '') ELSE text END AS body FROM took),
mended AS (
  SELECT book AS doc_id, page, line_no, CASE WHEN up THEN regexp_replace(body, '[-–—]$', '') || regexp_extract(after, '^(\S+)', 1) ELSE body END AS text FROM cutoff)"""


def _part(e: str) -> str:
    return f"replace(replace(replace(replace(replace(url_encode({e}), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')"


def sql() -> dict[str, str]:
    functions = _list(T.FUNCTION_WORDS)
    return {
        "page_number_lines": f"""WITH p AS (
  SELECT doc_id, unnest(string_split(text || chr(10) || ['- ', 'Page ', ''][doc_id % 3 + 1] || doc_id % 12000 || CASE WHEN doc_id % 3 = 1 THEN ' of 900' ELSE '' END, chr(10))) AS raw FROM documents)
SELECT doc_id, count(*) AS n_lines, max(raw) AS last FROM p WHERE regexp_matches({_trim('raw')}, {_s(T.PAGE_NUMBER)}) GROUP BY doc_id""",
        "running_lines": f"WITH {LINES}, {EDGES} SELECT source, key, pages, running FROM running",
        "body_lines": f"""WITH {LINES}, {EDGES},
drop AS (
  SELECT doc_id, line_no FROM edges LEFT JOIN (SELECT source, key FROM running WHERE running) r USING (source, key)
  WHERE r.key IS NOT NULL OR regexp_matches(text, {_s(T.PAGE_NUMBER)}))
SELECT doc_id, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM lines ANTI JOIN drop USING (doc_id, line_no) GROUP BY doc_id""",
        "paragraphs": f"WITH {BLOCKS} SELECT doc_id, block, t, md5(text) AS text_md5 FROM blocks",
        "char_index": f"WITH {BLOCKS} SELECT doc_id, block, chars_before, total FROM indexed",
        "toc_headings": f"WITH {LINES} SELECT doc_id, count(*) AS n, min(line_no)::INT AS first_line FROM lines WHERE {_heading('text')} GROUP BY doc_id",
        "sections": f"""WITH {BLOCKS},
starts AS (SELECT doc_id, block, CASE WHEN t = 'h' THEN text ELSE 'Start' END AS title, n FROM indexed WHERE t = 'h' OR block = 0),
spans AS (SELECT *, coalesce(lead(block) OVER (PARTITION BY doc_id ORDER BY block), n)::INT AS stop FROM starts)
SELECT doc_id, title, start::INT AS start, least(start + 5, stop)::INT AS "end" FROM (SELECT *, unnest(generate_series(block, stop - 1, 5)) AS start FROM spans)""",
        "position_to_chapter": f"""WITH {BLOCKS}
SELECT p.doc_id, p.block, coalesce(max_by(e.text, e.block) FILTER (e.block <= p.block), '') AS title, coalesce(min(e.block) FILTER (e.block > p.block), any_value(p.n))::INT AS "end"
FROM indexed p LEFT JOIN (SELECT * FROM blocks WHERE t = 'h') e USING (doc_id) GROUP BY p.doc_id, p.block""",
        "chapter_levels": f"""WITH {BLOCKS}, e AS (SELECT doc_id, block, text, CASE WHEN t = 'h' THEN 0 ELSE 1 END AS level FROM blocks WHERE t = 'h' OR (t = 'p' AND length(text) < 40)),
here AS (SELECT p.doc_id, p.block, p.n, max({{'b': e.block, 'l': e.level, 't': e.text}}) FILTER (e.block <= p.block) AS f FROM indexed p LEFT JOIN e USING (doc_id) GROUP BY ALL)
SELECT a.doc_id, a.block, md5(coalesce(a.f.t, '')) AS title_md5, coalesce(min(e.block), any_value(a.n))::INT AS "end"
FROM here a LEFT JOIN e ON e.doc_id = a.doc_id AND e.block > a.block AND e.level <= coalesce(a.f.l, 2) GROUP BY a.doc_id, a.block, a.f""",
        "position_to_section": f"""WITH {BLOCKS},
starts AS (SELECT doc_id, block, CASE WHEN t = 'h' THEN text ELSE 'Start' END AS title, n FROM indexed WHERE t = 'h' OR block = 0),
spans AS (SELECT *, coalesce(lead(block) OVER (PARTITION BY doc_id ORDER BY block), n)::INT AS stop FROM starts),
cut AS (SELECT doc_id, title, start::INT AS start, least(start + 5, stop)::INT AS "end" FROM (SELECT *, unnest(generate_series(block, stop - 1, 5)) AS start FROM spans))
SELECT b.doc_id, b.block, title, start, "end" FROM blocks b JOIN cut c ON c.doc_id = b.doc_id AND b.block >= c.start AND b.block < c."end" """,
        "hits_in_sections": f"""WITH {HITS} SELECT doc_id, (block // 10 * 10)::INT AS start, count(*) AS n FROM limited WHERE k <= 300 GROUP BY 1, 2""",
        "open_position": f"""WITH {BLOCKS}, s AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id)
SELECT doc_id, least(CASE WHEN doc_id % 2 = 0 AND doc_id % 40 < n THEN doc_id % 40 ELSE n_chars % 30 END, n - 1)::INT AS block FROM s JOIN documents USING (doc_id)""",
        "library_sorts": f"""WITH {BOOKS} SELECT book_id, row_number() OVER (PARTITION BY collections[1] ORDER BY greatest(last_read, added) DESC, book_id)::INT AS recent,
  row_number() OVER (PARTITION BY collections[1] ORDER BY added DESC, book_id)::INT AS added, row_number() OVER (PARTITION BY collections[1] ORDER BY {_fold('title')}, book_id)::INT AS title,
  row_number() OVER (PARTITION BY collections[1] ORDER BY {_fold('author')}, {_fold('title')}, book_id)::INT AS author, row_number() OVER (PARTITION BY collections[1] ORDER BY progress DESC, book_id)::INT AS progress FROM books""",
        "collection_names": f"WITH {BOOKS} SELECT unnest(collections) AS name FROM books UNION SELECT lower(n_name) FROM nation",
        "collection_toggle": f"""WITH {BOOKS} SELECT book_id, array_to_string(CASE WHEN list_contains(collections, 'en') THEN list_filter(collections, lambda c: c <> 'en') ELSE list_append(collections, 'en') END, ',') AS collections FROM books""",
        "auto_status": f"WITH {BOOKS} SELECT reading_status, 'reading' AS after, count(*) AS n FROM books GROUP BY 1, 2",
        "lookup_url": rf"""WITH w AS (SELECT doc_id, lang, unnest([regexp_extract(text, '\S+'), regexp_extract(text, '\S+\s+\S+')]) AS said FROM documents)
SELECT doc_id, said, CASE WHEN regexp_matches(said, '\s') THEN 'https://www.google.com/search?q=' || {_part("'define ' || said[1:200]")}
  ELSE 'https://' || lang[1:2] || '.wiktionary.org/wiki/' || {_part("lower(said[1:200])")} END AS url FROM w WHERE said <> ''""",
        "escaped_html": "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_md5 FROM pages",
        "scan_pages": rf"SELECT source, CASE WHEN length(regexp_replace(text, '\s', '', 'g')) < 40 THEN 'pending' ELSE 'text' END AS state, count(*) AS n FROM documents GROUP BY 1, 2",
        "scan_layers": """WITH RECURSIVE o AS (
  SELECT doc_id, i, n, n % 6 AS op, [n % 7 + 1, n % 3, n % 2, n % 5 + 1, n, 0]::DOUBLE[] AS a FROM (
    SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
walk AS (
  SELECT doc_id, 0 AS i, [1, 0, 0, 1, 0, 0]::DOUBLE[] AS m, []::DOUBLE[][] AS saved, false AS hit FROM documents
  UNION ALL
  SELECT w.doc_id, o.i, CASE op WHEN 1 THEN CASE WHEN len(saved) > 0 THEN saved[len(saved)] ELSE [1, 0, 0, 1, 0, 0]::DOUBLE[] END
      WHEN 2 THEN [m[1] * a[1] + m[3] * a[2], m[2] * a[1] + m[4] * a[2], m[1] * a[3] + m[3] * a[4], m[2] * a[3] + m[4] * a[4], m[1] * a[5] + m[3] * a[6] + m[5], m[2] * a[5] + m[4] * a[6] + m[6]] ELSE m END,
    CASE op WHEN 0 THEN list_append(saved, m) WHEN 1 THEN saved[1:len(saved) - 1] ELSE saved END,
    hit OR (op = 4 AND n % 50 = 3) OR (op = 3 AND abs(m[1] * m[4] - m[2] * m[3]) > 300)
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1)
SELECT doc_id, bool_or(hit) AS scan FROM walk GROUP BY doc_id""",
        "recognised_lines": rf"""WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r FROM documents),
w AS (
  SELECT *, length(line) AS n, (length(line) * 7) % 101 AS conf, CASE WHEN r % 7 = 0 THEN 40 ELSE 20 END AS h,
    CASE WHEN length(line) % 11 > 0 THEN list_filter(string_split_regex(line, {_s(T.WS + '+')}), lambda x: x <> '') ELSE [] END AS ws FROM l),
p AS (SELECT *, list_sort(list(h) OVER (PARTITION BY doc_id))[(count(*) OVER (PARTITION BY doc_id)) // 2 + 1] AS ph FROM w),
c AS (
  SELECT *, list_filter(list_transform(ws, lambda x, i: {{'t': x, 'c': (length(x) * 37 + r * 11 + (i - 1) * 5) % 101}}),
    lambda y: (y.c >= 25 OR {_share('y.t')} > 0.6) AND NOT (regexp_matches(y.t, {_s(T.STRAY_MARK)}) AND y.t <> '...')) AS good FROM p),
t AS (SELECT *, h >= 1.3 * ph AND len(good) BETWEEN 1 AND 12 AS title FROM c),
k AS (
  SELECT *, CASE WHEN title THEN list_filter(good, lambda y: y.c >= 70 AND regexp_replace(y.t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') <> ''
      AND (y.c >= 80 OR regexp_matches(regexp_replace(y.t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), '^[\p{{N}}IVXLCivxlc.:,)(-]+$'))) ELSE good END AS kept
  FROM t WHERE title OR conf >= 55 OR (conf >= 35 AND {_share('line')} > 0.9 AND n > 20)),
s AS (
  SELECT *, {_trim(f"regexp_replace(CASE WHEN len(kept) > 0 THEN array_to_string(list_transform(kept, lambda y: y.t), ' ') ELSE line END, {_s(T.WS + '+')}, ' ', 'g')")} AS said
  FROM k WHERE NOT title OR len(kept) / len(good) >= 0.5)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1)::INT AS line_no, md5(said) AS text_md5, 20.0::DOUBLE AS x, r * 15.0::DOUBLE AS y, n * 4.0::DOUBLE AS w, round(h / 2.0 * 0.85, 6)::DOUBLE AS size
FROM s WHERE said <> '' AND {_share('said')} >= 0.55 AND (length(said) > 1 OR regexp_matches(said, '[0-9]'))""",
        "job_control": """SELECT source, count(*) FILTER (n_chars < 200) AS skipped, count(*) AS pages, count(*) FILTER (n_chars < 200) > 0 AND count(*) FILTER (n_chars < 60) <= 3 AS resumes FROM documents GROUP BY source""",
        "retry_classes": """WITH a AS (SELECT CASE WHEN event_type <> 'error' THEN (floor(value)::BIGINT % 5 * 100 + 200)::INT END AS code, CASE WHEN event_id % 3 > 0 THEN 1 END AS blocks FROM events)
SELECT code, (code IS NULL OR code = 429 OR code >= 500 OR (code < 400 AND blocks IS NULL)) AS again, count(*) AS n FROM a GROUP BY 1, 2""",
        "fenced_json": """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS json FROM documents""",
        "english_books": """SELECT lang, CASE WHEN n_chars % 4 = 0 THEN n_chars % 8 = 0 ELSE lang = 'en' END AS english, count(*) AS n FROM documents GROUP BY 1, 2""",
        "loaded_ranks": """SELECT word, row_number() OVER (ORDER BY ord) - 1 AS rank FROM (SELECT word, min(ord) AS ord FROM (
  SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey * 100 + generate_subscripts(string_split(p_name, ' '), 1) AS ord FROM part) WHERE word <> '' GROUP BY word)""",
        "matched_case": """SELECT tok, CASE WHEN length(tok) > 1 AND tok = upper(tok) THEN upper(reverse(tok)) WHEN regexp_matches(tok, '^[A-Z]') THEN upper(lower(reverse(tok))[1]) || lower(reverse(tok))[2:] ELSE lower(reverse(tok)) END AS word
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS tok FROM documents)""",
        "percent_to_block": f"""WITH {BLOCKS}
SELECT doc_id, percent, max(block) AS block FROM indexed, (SELECT unnest([0.0, 25.0, 50.0, 99.5, 120.0]::DOUBLE[]) AS percent)
WHERE chars_before <= least(100.0, percent)::DOUBLE / 100 * total GROUP BY doc_id, percent""",
        "approx_pages": f"""WITH {BLOCKS}, m AS (SELECT doc_id, sum(length(text) + 1)::BIGINT AS chars, sum(length(text) + 1)::BIGINT / 1500 AS minutes FROM blocks GROUP BY doc_id)
SELECT doc_id, greatest(1, ceil(chars / 1500))::BIGINT AS pages, minutes, CASE WHEN minutes < 1 THEN 'less than a minute' WHEN minutes < 60 THEN {_half_up('minutes')} || ' min'
  WHEN {_half_up('minutes % 60')} <> 0 THEN floor(minutes / 60)::BIGINT || ' h ' || {_half_up('minutes % 60')} || ' min' ELSE floor(minutes / 60)::BIGINT || ' h' END AS shown FROM m""",
        "page_to_block": "SELECT source, page, min(doc_id) AS block FROM documents, (SELECT unnest([0, 100, 333]::INT[]) AS page) WHERE doc_id >= page GROUP BY source, page",
        "search_hits": f'WITH {HITS} SELECT doc_id, block::INT AS block, query, start::INT AS start, "end"::INT AS "end" FROM limited WHERE k <= 300',
        "search_snippets": f"""WITH {HITS}
SELECT doc_id, query, CASE WHEN start > 40 THEN '…' ELSE '' END || substr(text, (greatest(start - 40, 0) + 1)::INT, ("end" + 60 - greatest(start - 40, 0))::INT)
  || CASE WHEN "end" + 60 < length(text) THEN '…' ELSE '' END AS snippet FROM limited WHERE k = 1""",
        "word_ranks": f"WITH {RANKS} SELECT word, rank FROM ranks",
        "dictionary_ratio": f"""WITH {RANKS}, {_cores(2)}, seen AS (SELECT doc_id, count(*) AS words, count(rank) AS known FROM cores LEFT JOIN ranks USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(words, 0) AS words, coalesce(known, 0) AS known, round(coalesce(known / words, 1.0), 6) AS ratio FROM documents LEFT JOIN seen USING (doc_id)""",
        "text_quality": f"WITH {QUALITY} SELECT doc_id, words, round(unknown_ratio, 6) AS unknown_ratio, letter_spaced, round(junk_ratio, 6) AS junk_ratio, {POOR} AS poor FROM quality",
        "poor_docs": f"WITH {QUALITY} SELECT source, count(*) AS n_poor FROM quality WHERE {POOR} GROUP BY source",
        "split_glued": f"""WITH {RANKS}, {_cores(3, "lang = 'en'")},
unknown AS (SELECT DISTINCT word FROM cores ANTI JOIN ranks USING (word) WHERE regexp_matches(word, '^[a-z]+$')),
cut AS (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(generate_series(1, length(word) - 1))::INT AS i FROM unknown)),
good AS (
  SELECT cut.word, cut.a || ' ' || cut.b AS split FROM cut JOIN ranks ra ON ra.word = cut.a JOIN ranks rb ON rb.word = cut.b
  WHERE (cut.a IN {functions} AND (length(cut.b) >= 2 OR cut.b IN {functions})) OR (length(cut.a) >= 3 AND length(cut.b) >= 3 AND ra.rank < 3000 AND rb.rank < 3000)
    OR (cut.b IN {functions} AND length(cut.a) >= 3 AND ra.rank < 3000))
SELECT word, min(split) AS split FROM good GROUP BY word HAVING count(*) = 1""",
        "join_broken_words": rf"""WITH {RANKS},
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE lang = 'en'),
toks AS (
  SELECT doc_id, line_no, unnest(string_split_regex({_trim('line')}, {_s(T.WS + '+')})) AS tok, generate_subscripts(string_split_regex({_trim('line')}, {_s(T.WS + '+')}), 1) - 1 AS tok_no FROM raw),
pairs AS (SELECT *, lead(tok) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS next FROM toks),
ab AS (
  SELECT *, lower(regexp_extract(tok, '^[^\p{{L}}\p{{N}}]*(\p{{L}}+)$', 1)) AS a, coalesce(lower(regexp_extract(next, '^(\p{{L}}+)[^\p{{L}}\p{{N}}]*$', 1)), '') AS b FROM pairs),
cand AS (
  SELECT ab.*, (a <> '' AND b <> '' AND rab.word IS NOT NULL AND (ra.word IS NULL OR rb.word IS NULL))::INT AS c FROM ab
  LEFT JOIN ranks ra ON ra.word = a LEFT JOIN ranks rb ON rb.word = b LEFT JOIN ranks rab ON rab.word = a || b),
islands AS (SELECT *, sum(1 - c) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS island FROM cand)
SELECT doc_id, line_no::INT AS line_no, tok_no::INT AS tok_no, tok || next AS joined FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, island ORDER BY tok_no) AS k FROM islands WHERE c = 1) WHERE k % 2 = 1""",
        "stray_marks": f"""SELECT doc_id, count(*) AS n_marks FROM (SELECT doc_id, unnest(string_split_regex(text, {_s(T.WS + '+')})) AS tok FROM documents)
WHERE regexp_matches(tok, {_s(T.STRAY_MARK)}) AND tok <> '...' GROUP BY doc_id""",
        "sentences": f"""WITH {_sentences("doc_id")} SELECT doc_id, sentence_no, min(b) AS start, max(b + length(w)) AS "end", md5(string_agg(w, ' ' ORDER BY i)) AS text_md5 FROM numbered GROUP BY doc_id, sentence_no""",
        "sentence_at": f"""WITH {_sentences("doc_id")}, spans AS (SELECT doc_id, sentence_no, min(b) AS start, max(b + length(w)) AS "end" FROM numbered GROUP BY doc_id, sentence_no),
asked AS (SELECT unnest([0, 40, 333, 1000]::BIGINT[]) AS place)
SELECT doc_id, place, sentence_no, start, "end" FROM spans, asked WHERE place >= start AND place < "end" """,
        "speech_cursor": f"""WITH {_sentences("doc_id, block", "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS block FROM documents)")},
spans AS (SELECT doc_id, block, sentence_no, min(b) AS start, max(b + length(w)) AS "end" FROM numbered GROUP BY doc_id, block, sentence_no),
own AS (SELECT doc_id, block, min(start) FILTER ("end" > 10) AS s, min("end") FILTER ("end" > 10) AS e, min(start) AS s0, min("end") AS e0 FROM spans GROUP BY doc_id, block),
lines AS (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS block FROM documents),
after AS (
  SELECT l.doc_id, l.block, o.s, o.e, min({{'b': n.block, 's': n.s0, 'e': n.e0}}) FILTER (n.block > l.block) AS nx FROM lines l
  LEFT JOIN own o ON o.doc_id = l.doc_id AND o.block = l.block LEFT JOIN own n ON n.doc_id = l.doc_id AND n.block > l.block GROUP BY ALL)
SELECT doc_id, block, CASE WHEN e IS NOT NULL THEN block ELSE nx.b END AS said, CASE WHEN e IS NOT NULL THEN greatest(s, 10) ELSE nx.s END AS start, coalesce(e, nx.e) AS "end"
FROM after WHERE e IS NOT NULL OR nx IS NOT NULL""",
        "word_at": f"""WITH p AS (SELECT doc_id, text, place, least(place, length(text))::INT AS pos FROM documents, (SELECT unnest([0, 7, 40, 1000, 10000000]::INT[]) AS place)),
q AS (SELECT *, CASE WHEN NOT regexp_matches(substr(text, pos + 1, 1), {_s(_WORD)}) AND pos > 0 AND regexp_matches(substr(text, pos, 1), {_s(_WORD)}) THEN pos - 1 ELSE pos END AS k FROM p),
r AS (SELECT doc_id, place, regexp_extract(substr(text, 1, k), {_s('(' + _WORD + '*)$')}, 1) AS l, regexp_extract(substr(text, k + 1), {_s('^(' + _WORD + '*)')}, 1) AS r FROM q)
SELECT doc_id, place, word FROM (SELECT doc_id, place, r, regexp_replace(l || r, {_s("^['’-]+|['’-]+$")}, '', 'g') AS word FROM r) WHERE r <> '' AND word <> ''""",
        "word_spans": f"""WITH w AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(text, chr(10), ' '), {_s(_WORD + '+')}), lambda x: regexp_replace(x, {_s("^['’-]+|['’-]+$")}, '', 'g')), lambda x: x <> '') AS v FROM documents)
SELECT doc_id, len(v)::BIGINT AS n_words, md5(array_to_string(v, ' ')) AS words_md5 FROM w""",
        "library_view": f"""WITH {BOOKS} SELECT book_id, md5(title) AS title_md5, greatest(last_read, added) AS recent FROM books
WHERE favorite AND list_contains(collections, 'en') AND contains(lower(concat_ws(' ', title, coalesce(author, ''), file_name)), 'src1')""",
        "library_by_author": f"""WITH {BOOKS} SELECT author, count(*) OVER (PARTITION BY author) AS n, row_number() OVER (PARTITION BY author ORDER BY book_id) AS place, book_id
FROM (SELECT coalesce(nullif(trim(author), ''), 'Unknown author') AS author, book_id FROM books)""",
        "status_of": f"""WITH {BOOKS} SELECT coalesce(reading_status, CASE WHEN progress >= 0.98 THEN 'read' WHEN last_read <> 0 THEN 'reading' ELSE 'none' END) AS status, count(*) AS n FROM books GROUP BY 1""",
        "collections": f"WITH {BOOKS} SELECT name, count(*) AS n FROM (SELECT unnest(collections) AS name FROM books) GROUP BY name",
        "cover_hue": rf"""WITH {BOOKS} SELECT book_id, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(title, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: (h * 31 + c) % 360) AS hue FROM books""",
        "bold_starts": r"""WITH """ + BOOKS + r""" SELECT book_id, md5(array_to_string(list_transform(regexp_extract_all('<i>' || title || '</i>', '<[^>]*>|\p{L}+|[^<\p{L}]+|<'),
  lambda p: CASE WHEN regexp_matches(p, '^\p{L}{2,}$') THEN '<b class="bs">' || substr(p, 1, ceil(length(p) / 2)::INT) || '</b>' || substr(p, ceil(length(p) / 2)::INT + 1) ELSE p END), '')) AS html_md5 FROM books""",
        "reading_days": f"WITH {ACTIVITY}, {_days(120)} SELECT user_id, day, micros, chars FROM days",
        "stats_view": f"""WITH {ACTIVITY}, {_days(86400)},
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM days),
t AS (SELECT user_id, count(*) AS days_read, sum(chars)::BIGINT AS chars, sum(micros)::BIGINT AS micros, coalesce(sum(micros) FILTER (k <= 7), 0)::BIGINT AS last7_micros FROM k GROUP BY user_id)
SELECT *, {_half_up(_half_up('chars / 1500') + ' / days_read')} AS pages_per_day, round(CASE WHEN micros > 60000000 THEN chars / (micros / 1000000 / 60) ELSE 0.0 END, 6) AS chars_per_minute FROM t""",
        "failure_streaks": """WITH c AS (SELECT user_id, event_id, event_type NOT IN ('error', 'click', 'view') AS ok FROM events),
r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
s AS (SELECT *, (sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id))::BIGINT AS streak FROM r)
SELECT user_id, event_id, streak, max((streak >= 4)::INT) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS open FROM s""",
        "rebuild_triggers": """WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type <> 'error' AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS done, 0 AS since, false AS rebuild FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, i, d, CASE WHEN r THEN 0 ELSE s END, r FROM (
    SELECT *, NOT page OR d <= 3 OR s >= 4 AS r FROM (
      SELECT e.user_id, e.i, e.page, w.done + e.page::INT AS d, CASE WHEN e.page THEN w.since + 1 ELSE 0 END AS s FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)))
SELECT user_id, event_id, done, rebuild FROM w JOIN e USING (user_id, i)""",
        "stored_library": """WITH rows AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents),
epochs AS (SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN CASE WHEN doc_id % 33 = 3 THEN 4 END WHEN doc_id % 5 = 1 THEN 2 ELSE 1 END::BIGINT AS epoch FROM documents),
now AS (
  SELECT doc_id, block, text, epoch FROM rows JOIN epochs USING (doc_id) WHERE epoch <> 2
  UNION ALL SELECT doc_id, block // 2, string_agg(text, ' ' ORDER BY block), 2 FROM rows JOIN epochs USING (doc_id) WHERE epoch = 2 GROUP BY doc_id, block // 2),
idx AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block) - length(text) - 1 AS c, sum(length(text) + 1) OVER (PARTITION BY doc_id) AS total FROM now),
old AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block) - length(text) - 1 AS c, sum(length(text) + 1) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM rows),
share AS (SELECT doc_id, c / total AS share FROM old WHERE block = floor(n * 0.6::DOUBLE))
SELECT doc_id, count(*) AS n, max(epoch) AS epoch, sum(length(text))::BIGINT AS chars, max(block) FILTER (c <= share * total)::INT AS place FROM idx JOIN share USING (doc_id) GROUP BY doc_id""",
        "reading_position": f"""WITH {BLOCKS},
cut AS (
  SELECT doc_id, s::INT AS start, least(s + 5, stop)::INT AS stop FROM (SELECT *, unnest(generate_series(block, stop - 1, 5)) AS s FROM (
    SELECT doc_id, block, coalesce(lead(block) OVER (PARTITION BY doc_id ORDER BY block), n) AS stop FROM indexed WHERE t = 'h' OR block = 0))),
ends AS (
  SELECT p.doc_id, p.block, p.chars_before, p.total, coalesce(min(e.chars_before), any_value(p.total)) AS ce FROM indexed p LEFT JOIN (SELECT * FROM indexed WHERE t = 'h') e ON e.doc_id = p.doc_id AND e.block > p.block GROUP BY ALL),
spot AS (
  SELECT e.*, doc_id % 4 + 1 AS pages, a.chars_before AS sc, coalesce(b.chars_before, e.total) AS ec FROM ends e JOIN cut c USING (doc_id)
  JOIN indexed a ON a.doc_id = e.doc_id AND a.block = c.start LEFT JOIN indexed b ON b.doc_id = e.doc_id AND b.block = c.stop WHERE e.block >= c.start AND e.block < c.stop),
here AS (SELECT *, CASE WHEN pages > 1 THEN sc + (ec - sc) * (block % pages) / pages ELSE chars_before END::DOUBLE AS here FROM spot)
SELECT doc_id, block, round(least(1.0::DOUBLE, here / total), 6) AS progress, round(greatest(0.0::DOUBLE, (ce - greatest(here, chars_before)) / 1500), 6) AS minutes FROM here""",
        "render_scales": """WITH p AS (SELECT doc_id, (200 + length(source) * 60)::DOUBLE AS w, (100 + n_chars % 3000)::DOUBLE AS h FROM documents)
SELECT doc_id, round(greatest(1.0::DOUBLE, least(300 / 72, sqrt(8500000 / (w * h)))), 6) AS "full", round(greatest(1.0::DOUBLE, least(300 / 72, sqrt(5000000 / (w * h)))), 6) AS low_memory FROM p""",
        "provider_outcome": """WITH d AS (
  SELECT source, doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN n_chars * (doc_id % 10) / 10 END AS f, CASE WHEN doc_id % 5 = 0 THEN n_chars / 2 END AS s,
    CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE 0 END AS o FROM documents)
SELECT source, CASE WHEN f IS NOT NULL THEN CASE WHEN o > 0 AND f < o * 0.3::DOUBLE THEN 'kept-scanner-text' ELSE 'first' END
  WHEN s IS NOT NULL THEN CASE WHEN o > 0 AND s < o * 0.3::DOUBLE THEN 'kept-scanner-text' ELSE 'second' END
  WHEN o > 0 THEN 'kept-scanner-text' WHEN k % 2 = 0 THEN 'on-device' ELSE 'needs-consent' END AS outcome, count(*) AS n FROM d GROUP BY ALL""",
        "ewma_latency": "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, v: a * 0.85::DOUBLE + v * (1 - 0.85::DOUBLE)), 6) AS ewma FROM events GROUP BY user_id",
        "size_mode": f"""WITH {LINES}, k AS (SELECT source, {_half_up('length(text) / 5')} * 5 AS k, length(text) AS n, doc_id, line_no FROM lines),
b AS (SELECT source, k, sum(n) AS weight, min(doc_id * 1000000 + line_no) AS first FROM k GROUP BY source, k)
SELECT source, k AS mode FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, first) = 1""",
        "index_percentiles": f"""WITH {LINES}, v AS (SELECT doc_id, list_sort(list(length(text))) AS v, count(*) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, v[least(n, floor(n * 0.1) + 1)::INT] AS p10, v[least(n, floor(n * 0.5) + 1)::INT] AS median, v[least(n, floor(n * 0.8) + 1)::INT] AS p80, v[n] AS top FROM v""",
        "notes_export": f"""WITH {HITS}, last AS (SELECT doc_id, max(block) AS last FROM rows GROUP BY doc_id)
SELECT doc_id, count(*) AS n, md5(string_agg('"' || substr(text, (start + 1)::INT, ("end" - start)::INT) || '" (' || {_half_up('block / coalesce(nullif(last, 0), 1) * 100')} || '%)', chr(10) || chr(10) ORDER BY block, start, query)) AS notes_md5
FROM limited JOIN last USING (doc_id) WHERE k <= 300 GROUP BY doc_id""",
        "resolve_links": r"""SELECT page_id, ord::INT AS ord, 'OEBPS/' || array_to_string(list_filter(string_split(replace(url_decode(replace(href, '+', '%2B')), '/', 'x/./'), '/'), lambda s: s NOT IN ('', '.')), '/') || '#n' AS path
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), 1) - 1 AS ord FROM pages)""",
        "html_title_links": r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1))::BIGINT AS n_links FROM pages""",
        "contrast_ratio": f"""WITH c AS (SELECT DISTINCT source, substr(md5(source || 'a'), 1, 6) AS a, substr(md5(source || 'b'), 1, 6) AS b FROM documents),
l AS (SELECT source, {_luminance('a')} AS x, {_luminance('b')} AS y FROM c)
SELECT source, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 4) AS ratio FROM l""",
        "inline_markup": f"""WITH {_inline()}
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY run) - 1)::INT AS block, md5(text) AS text_md5, md5(html) AS html_md5, coalesce(spans, '') AS spans
FROM done LEFT JOIN ranges USING (page_id, run) WHERE {_trim('text')} <> ''""",
        "outline_walk": """WITH RECURSIVE items AS (
  SELECT *, CASE WHEN item % 10 = 0 THEN NULL WHEN item % 10 <= 3 THEN item - item % 10 WHEN item % 10 = 9 THEN item - 1 ELSE item - item % 10 + (item % 10 - 1) // 3 END AS parent FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS item FROM documents)),
walk AS (
  SELECT doc_id, item, line, 0 AS level, [{'p': -(item % 4), 'i': item}] AS path FROM items WHERE parent IS NULL
  UNION ALL SELECT c.doc_id, c.item, c.line, w.level + 1, list_append(w.path, {'p': -(c.item % 4), 'i': c.item}) FROM walk w JOIN items c ON c.doc_id = w.doc_id AND c.parent = w.item WHERE w.level < 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1)::INT AS ord, title, CASE WHEN item % 7 > 0 THEN item + 1 ELSE -1 END AS page, level
FROM (SELECT *, trim(trim(line, ' ')[1:40], ' ') AS title FROM walk) WHERE title <> ''""",
        "nav_toc": f"WITH {_nav()} SELECT book, toc_no::INT AS toc_no, title, block::INT AS block, level::INT AS level FROM toc",
        "spine_sections": f"""WITH {_nav()},
files AS (SELECT book, path, min(nr) AS start, max(nr) + 1 AS stop, min_by(text, nr) FILTER (head) AS head FROM spine GROUP BY book, path),
titled AS (
  SELECT f.*, (SELECT max_by(title, toc_no) FROM toc t WHERE t.book = f.book AND t.block <= f.start) AS entry FROM files f)
SELECT book, coalesce(entry, head, 'Start') AS title, s::INT AS start, least(s + 5, stop)::INT AS "end" FROM (SELECT *, unnest(generate_series(start, stop - 1, 5)) AS s FROM titled)""",
        "assembled_lines": f"""WITH w AS (
  SELECT doc_id, row, list_filter(string_split_regex({_trim('line')}, {_s(T.WS + '+')}), lambda x: x <> '') AS v FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1)::INT AS line_no, md5(array_to_string(v, ' ')) AS text_md5,
  round(15.0::DOUBLE * row - 0.8::DOUBLE * 11, 3) AS y, round(6.0::DOUBLE * length(array_to_string(v, ' ')), 3) AS w FROM w WHERE len(v) > 0""",
        "page_statistics": f"""WITH {_printed("source")}, {_page_stats("printed")} SELECT book, origin, page, body, "left", width, spacing, center FROM stats""",
        "printed_lines": f"""WITH {_printed("source")} SELECT book, page, count(*) AS n_lines, min(line_no)::INT AS first, max(line_no)::INT AS last, sum(length(text))::BIGINT AS n_chars FROM kept GROUP BY book, page""",
        "book_blocks": f"WITH RECURSIVE {_book_blocks()} SELECT doc_id, block::INT AS block, page, t, md5(text) AS text_md5 FROM book_blocks",
        "headings": f"WITH RECURSIVE {_book_blocks()} SELECT doc_id, page, text FROM book_blocks WHERE t = 'h'",
        "mended_line_ends": f"WITH RECURSIVE {_mended()} SELECT doc_id, page, line_no::INT AS line_no, md5(text) AS text_md5 FROM mended WHERE trim(text) <> ''",
        "transcribed_lines": f"""WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
typed AS (SELECT *, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ') AS t, CASE WHEN line = '' THEN 'hr' WHEN {_heading('line')} THEN 'h' ELSE 'p' END AS kind FROM raw),
kept AS (SELECT *, CASE kind WHEN 'hr' THEN 30.0 WHEN 'h' THEN 32.0 ELSE 11.0 * greatest(2, ceil(length(t) / 70)) END::DOUBLE AS step FROM typed WHERE kind = 'hr' OR t <> '')
SELECT doc_id, line_no::INT AS line_no, md5(CASE WHEN kind = 'hr' THEN '* * *' ELSE t END) AS text_md5,
  40.0::DOUBLE + coalesce(sum(step) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS y,
  CASE WHEN kind = 'h' THEN 16.0 ELSE 11.0 END::DOUBLE AS size, kind FROM kept""",
        "outline_toc": f"""WITH {BLOCKS}, paged AS (SELECT *, block // 3 + 1 AS page FROM blocks),
asked AS (SELECT DISTINCT doc_id, ord, want FROM documents, (SELECT unnest([1, 2, 3]) AS ord, unnest([1, 2, 5]) AS want)),
first AS (SELECT a.doc_id, a.ord, min(p.block) AS f, any_value(a.want) AS want FROM asked a JOIN paged p ON p.doc_id = a.doc_id AND p.page >= a.want GROUP BY a.doc_id, a.ord)
SELECT f.doc_id, f.ord::INT AS ord, coalesce(min(h.block), any_value(f.f))::INT AS block FROM first f
LEFT JOIN paged h ON h.doc_id = f.doc_id AND h.t = 'h' AND h.page = f.f // 3 + 1 AND h.block >= f.f GROUP BY f.doc_id, f.ord""",
    }
