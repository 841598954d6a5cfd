"""DuckDB SQL giving the same result as each query."""
from __future__ import annotations

from workload.adapters import AS_OF, BLOCK_SIZE, LINK, TIME_PHRASES

# Fixed values shared by the statements.
SPACE = r"\s\x1c-\x1f\x{85}\p{Z}"
AN = r"\p{L}\p{N}"


def _clean(c: str) -> str:
    c = f"replace(replace({c}, 'Óóä', ''), '¬†', '')"
    return f"coalesce(trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g')), '')"


def _anon(c: str) -> str:
    stripped = f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'anonymous' ELSE substr(md5(lower({stripped})), 1, 10) END"


def _attributes(c: str) -> str:
    item = "trim(regexp_replace(x, '^[^a-zA-Z0-9]+', ''))"
    return (
        f"array_to_string(list_filter(list_transform(string_split({_clean(c)}, '|'), lambda x: {item}),"
        " lambda x: x <> ''), ', ')"
    )


def _reltime(c: str, as_of: str) -> str:
    t = f"replace(lower({c}), 'diedit', '')"
    n = f"coalesce(try_cast(nullif(regexp_extract({t}, '([0-9]+)', 1), '') AS BIGINT), 1)"
    days = " ".join(
        f"WHEN contains({t}, '{unit}') THEN {as_of} - to_days(CAST({n} * {size} AS INTEGER))"
        for unit, size in (("hari", 1), ("minggu", 7), ("bulan", 30), ("tahun", 365))
    )
    return (
        f"CASE WHEN coalesce({c}, '') = '' THEN '' ELSE strftime(CASE"
        f" WHEN regexp_matches({t}, 'menit|detik|baru saja') THEN {as_of}"
        f" WHEN contains({t}, 'jam') THEN {as_of} - to_hours({n}) {days}"
        f" ELSE {as_of} END, '%Y-%m-%d') END"
    )


def _parse_rating(c: str) -> str:
    t = f"replace({c}, ',', '.')"
    shape = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return f"CASE WHEN regexp_matches({t}, '{shape}') THEN CAST(trim({t}) AS DOUBLE) ELSE 0.0::DOUBLE END"


_T = f"TIMESTAMP '{AS_OF}'"
_PHRASE = (
    "CASE WHEN doc_id % 9 = 1 THEN (doc_id % 400) || ' hari lalu' "
    + " ".join(f"WHEN doc_id % 9 = {i} THEN '{p}'" for i, p in enumerate(TIME_PHRASES) if i != 1)
    + " END"
)
REVIEWS = f"""reviews AS (
  SELECT lang AS file, doc_id AS pos, 'User ' || (n_chars % 37) AS user_name, text, {_PHRASE} AS time,
         CAST((doc_id * 7) % 11 % 8 AS BIGINT) AS rating,
         CASE WHEN (doc_id * 7) % 11 % 8 BETWEEN 1 AND 5 THEN (doc_id * 7) % 11 % 8 ELSE 0 END AS bucket
  FROM documents)"""

PLACES = f"""places AS (
  SELECT lang AS file, 'Place ' || lang AS place_name, 'Reviews in ' || lang AS place_description,
         'language' AS place_category, {_attributes("'- ' || lang || ' |  | * ' || n || ' texts'")} AS place_attributes,
         'Shelf ' || lang AS place_address, n AS place_total_reviews_gmaps,
         {_parse_rating("(n % 5) || ',' || (n % 10)")} AS place_avg_rating
  FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))"""


def _sample(source: str, cap: int) -> str:
    """CTEs ending in `sampled` (file, pos) from a relation with file, pos, bucket."""
    return f"""
h AS (SELECT file, pos, bucket, md5('42:core:' || file || ':' || pos) AS h1,
             md5('42:fill:' || file || ':' || pos) AS h2 FROM {source}),
starred AS (SELECT *, count(*) OVER (PARTITION BY file) AS n,
                   row_number() OVER (PARTITION BY file, bucket ORDER BY h1, pos) AS r1 FROM h),
cored AS (SELECT *, CASE WHEN bucket BETWEEN 1 AND 5 AND r1 <= {cap // 5} THEN 1 ELSE 0 END AS core FROM starred),
filled AS (SELECT *, sum(core) OVER (PARTITION BY file) AS taken,
                  row_number() OVER (PARTITION BY file, core ORDER BY h2, pos) AS r2 FROM cored),
sampled AS (SELECT file, pos FROM filled WHERE n <= {cap} OR core = 1 OR r2 <= {cap} - taken)"""


ORACLE: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "clean_attributes": f"""SELECT doc_id, {_attributes("replace(text, '. ', ' | ')")} AS attributes FROM documents""",
    "anonymize_user": f"""
WITH names AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 50 = 1 THEN ' '
    WHEN c_custkey % 50 = 2 THEN NULL ELSE '  ' || c_name || chr(9) END AS name FROM customer)
SELECT c_custkey, {_anon('name')} AS user_id FROM names""",
    "relative_time": f"WITH {REVIEWS} SELECT pos, time, {_reltime('time', _T)} AS review_time FROM reviews",
    "relative_time_orders": f"""
WITH t AS (SELECT o_orderkey, o_orderdate, (o_custkey % 100) || ' ' ||
    ['menit','jam','hari','minggu','bulan','tahun'][o_orderkey % 6 + 1] || ' yang lalu' AS phrase FROM orders)
SELECT o_orderkey, {_reltime('phrase', 'o_orderdate')} AS back_then FROM t""",
    "parse_int": """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'ulasan' WHEN o_orderkey % 20 = 1 THEN NULL
    ELSE (o_orderkey // 1000) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' ulasan' END AS s FROM orders)
SELECT o_orderkey, coalesce(try_cast(nullif(regexp_replace(s, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS n_reviews FROM t""",
    "parse_rating": f"""
WITH p AS (SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS price FROM part),
t AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN replace(price, '.', ',') WHEN 1 THEN price || 'f'
    WHEN 2 THEN '1.' || price WHEN 3 THEN ' ' || price || ' ' WHEN 4 THEN NULL ELSE price END AS s FROM p)
SELECT p_partkey, {_parse_rating('s')} AS rating FROM t""",
    "rating_bucket": """
SELECT l_orderkey, l_linenumber, CASE WHEN trunc(l_quantity / 8 - 0.5) BETWEEN 1 AND 5
    THEN CAST(trunc(l_quantity / 8 - 0.5) AS BIGINT) ELSE 0 END AS bucket FROM lineitem""",
    "slugify": f"""
SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^{AN}_{SPACE}-]', '', 'g'),
    '[{SPACE}-]+', '_', 'g') AS slug FROM documents""",
    "sanitize_key": f"""
SELECT c_custkey, trim(regexp_replace(c_name || ' / Ñ-' || c_mktsegment || ': ', '[^{AN} _-]', '', 'g')) AS safe_name
FROM customer""",
    "first_line": "SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents",
    "nonblank_filter": r"""
SELECT doc_id FROM documents WHERE length(regexp_replace(
    CASE WHEN doc_id % 10 = 0 THEN chr(10) || ' ' || chr(65279) ELSE text END,
    '[\t\n\x0b\f\r\p{Zs}\x{2028}\x{2029}\x{feff}]+', '', 'g')) > 0""",
    "variant_default": """
SELECT event_id, ['default', 'null', 'value'][event_id % 3 + 1] AS state,
    CASE event_id % 3 WHEN 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END AS k FROM events""",
    "filter_nonempty_reviews": f"""
SELECT doc_id FROM documents
WHERE {_clean("CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) || chr(12288) ELSE text END")} <> ''""",
    "dedup_keep_first": f"""
WITH {REVIEWS}, c AS (SELECT file, pos, {_clean('user_name')} AS "user", {_clean('text')} AS text, rating FROM reviews)
SELECT * FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY file, "user", text ORDER BY pos) = 1""",
    "dedup_turns": f"""
WITH c AS (SELECT conv_id AS file, turn AS pos, role AS user_name, {_clean('text')} AS text FROM conversations)
SELECT * FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY file, user_name, text ORDER BY pos) = 1""",
    "stratified_sample_reviews": f"""
WITH {REVIEWS}, {_sample('reviews', 150)}
SELECT file, pos, rating, text FROM reviews JOIN sampled USING (file, pos)""",
    "stratified_sample_events": f"""
WITH e AS (SELECT user_id AS file, event_id AS pos, event_type, CASE WHEN CAST(floor(value) AS BIGINT) % 7 BETWEEN 1 AND 5
    THEN CAST(floor(value) AS BIGINT) % 7 ELSE 0 END AS bucket FROM events), {_sample('e', 50)}
SELECT file, pos, bucket, event_type FROM e JOIN sampled USING (file, pos)""",
    "shuffle_rank": """
SELECT user_id AS file, event_id AS pos, md5('42:order:' || user_id || ':' || event_id) AS shuffle_rank FROM events""",
    "union_files": """
SELECT doc_id AS pos, text FROM documents UNION ALL SELECT turn AS pos, text FROM conversations
UNION ALL SELECT doc_id AS pos, text FROM documents""",
    "project_order_orders": "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders",
    "rating_distribution": f"""
WITH {REVIEWS} SELECT rating AS user_rating, count(*) AS n FROM reviews WHERE pos % 13 <> 0
GROUP BY rating ORDER BY rating""",
    "run_counts_reviews": f"""
WITH {REVIEWS} SELECT count(*) AS n_rows, count(DISTINCT file) AS n_places, count(DISTINCT user_name) AS n_users
FROM reviews""",
    "preview_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "curated_reviews": f"""
WITH {REVIEWS}, {PLACES},
c AS (SELECT file, pos, bucket, rating, time, {_clean('user_name')} AS u, {_clean('text')} AS t FROM reviews),
d AS (SELECT * FROM c WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY file, u, t ORDER BY pos) = 1),
{_sample('d', 150)}
SELECT {_anon('u')} AS user_id, rating AS user_rating, t AS review_text, {_reltime('time', _T)} AS review_time,
       place_name, place_description, place_category, place_attributes, place_address,
       place_total_reviews_gmaps, place_avg_rating
FROM d JOIN sampled USING (file, pos) LEFT JOIN places USING (file)""",
}


# ---- pages -----------------------------------------------------------------------------------


def _decode(c: str) -> str:
    """Entities that occur in the test pages."""
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{entity};?', '{char}', 'g')"
    return c


def _first(pattern: str, default: str = "") -> str:
    return f"coalesce(regexp_extract_all(html, '{pattern}', 1)[1], '{default}')"


def _unnest(keys: str, values: str, source: str) -> str:
    """(keys…, pos, x) from list expressions."""
    return f"SELECT {keys}, unnest(range(len({values}))) AS pos, unnest({values}) AS x FROM {source}"


def _shown(c: str) -> str:
    """Inner markup as a page shows it: <br> a newline, other tags gone, spaces squeezed."""
    c = f"regexp_replace({c}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
    c = f"regexp_replace({c}, ' *<br> *', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    c = f"regexp_replace({c}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    return _decode(c)


_PLACE_PAGES = """pages_n AS (SELECT page_id, len(regexp_extract_all(html, '<p>')) + 1 AS n FROM pages WHERE page_id % 3 <> 0),
placed AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0 ELSE n - n // 4 END AS n_reviews,
                  CASE WHEN page_id % 5 = 0 THEN 0 WHEN n % 4 = 0 THEN n - 1 ELSE n END AS last FROM pages_n)"""
_LINKS = f"""links AS ({_unnest("page_id", f"list_zip(regexp_extract_all(html, '{LINK}', 1), regexp_extract_all(html, '{LINK}', 2))", "pages")})"""
_BLOCKS = rf"""blocks AS ({_unnest("page_id", "list_filter(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13)) <> '')", "pages")})"""
# A paragraph ends at its end tag, at the next one's start, or where its parent ends.
_BODY = "regexp_replace(html, '(?s)<script.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g')"
_CLOSED = f"regexp_replace({_BODY}, '(<p>|</article>|<footer|$)', '</p>\\1', 'g')"
_PARAGRAPHS = rf"""paragraphs AS ({_unnest("page_id, url, html", f"regexp_extract_all({_CLOSED}, '(?s)<p>(.*?)</p>', 1)", "pages")}),
cards AS (SELECT page_id, url, html, pos, {_shown("x")} AS text,
    CASE WHEN contains(x, '<b>') THEN {_shown("regexp_extract(x, '(?s)<b>(.*)', 1)")} END AS bold,
    CASE WHEN contains(x, '<b>') THEN len(regexp_extract_all(x, '<br>')) ELSE 0 END AS stars FROM paragraphs)"""
_PAGE_PLACES = """page_places AS (SELECT page_id AS pos, 'Page #' || (page_id // 2) || '!' AS place_name, url AS gmaps_url,
    'Page ' || (page_id // 2) AS doc_key FROM pages),
done AS (SELECT DISTINCT 'Page ' || (page_id // 2) AS doc_key FROM pages WHERE contains(url, '/de/')),
todo AS (SELECT * FROM page_places p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.doc_key = p.doc_key)),
firsts AS (SELECT * FROM todo QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY pos) = 1)"""

ORACLE |= {
    "extract_links": f"WITH {_LINKS} SELECT page_id, pos, x[2] AS place_name, x[1] AS gmaps_url FROM links WHERE x[1] <> '' AND x[2] <> ''",
    "picked_page_links": f"""WITH {_LINKS} SELECT page_id, pos, trim({_decode('x[2]')}) AS place_name, {_decode('x[1]')} AS gmaps_url
FROM links WHERE x[1] <> '' AND x[2] <> ''""",
    "pages_qualified": r"""SELECT page_id FROM pages WHERE regexp_matches(html, 'class="[^"]*lfPIob') OR regexp_matches(html, '<h1[\s>]')""",
    "page_metadata": f"""SELECT page_id, {_first("(?s)<h1>(.*?)</h1>")} AS name, {_first('<html lang="([^"]*)"')} AS category,
    replace({_first('<span aria-hidden="true">([^<]*)</span>', '0')}, ',', '.') AS avg_rating,
    {_first('aria-label="([^"]*(?:ulasan|reviews)[^"]*)"')} AS total_reviews_text,
    {_first("(?s)<footer>(.*?)</footer>")} AS address FROM pages""",
    "page_attributes": f"""SELECT page_id, {_first('<div class="ad">([^<]*)</div>')} AS description,
    array_to_string(list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: replace(x, chr(10), ': ')), ' | ') AS attributes
FROM pages""",
    "page_blocks": f"WITH {_BLOCKS} SELECT page_id, pos, x AS text FROM blocks WHERE pos < 400",
    "first_n_per_page": f"""WITH {_LINKS}, l AS (SELECT page_id, pos, x[2] AS place_name, x[1] AS gmaps_url FROM links WHERE x[1] <> '' AND x[2] <> '')
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3""",
    "picked_page_blocks": f"""WITH {_PARAGRAPHS} SELECT page_id, {_shown(_first("(?s)<h1>(.*?)</h1>"))} AS name, pos, text FROM cards""",
    "place_page_info": f"""WITH {_PARAGRAPHS}, n AS (SELECT page_id, count(*) AS n FROM cards WHERE text <> '' GROUP BY page_id)
SELECT page_id, {_shown(_first("(?s)<h1>(.*?)</h1>"))} AS name, {_first('<html lang="([^"]*)"')} AS category, '0' AS avg_rating,
    '' AS total_reviews_text, {_shown(_first("(?s)<footer>(.*?)</footer>"))} AS address,
    {_shown(_first('(?s)<div class="ad">(.*?)</div>'))} AS description,
    array_to_string(list_transform(regexp_extract_all(html, '{LINK}', 2), lambda x: trim({_decode('x')})), ' | ') AS attributes,
    least(coalesce(n, 0), 400) AS n_reviews FROM pages LEFT JOIN n USING (page_id)""",
    "assemble_documents": f"""WITH {_PARAGRAPHS}, {_PAGE_PLACES}
SELECT doc_key, place_name AS name, row_number() OVER (PARTITION BY doc_key ORDER BY cards.pos) - 1 AS pos, text
FROM firsts JOIN cards ON gmaps_url = url WHERE text <> ''""",
    "collect_place_documents": f"""WITH {_PAGE_PLACES}
SELECT doc_key, place_name AS name, '0' AS avg_rating, CAST(0 AS BIGINT) AS n_reviews FROM firsts""",
    "incremental_skip": f"WITH {_PAGE_PLACES} SELECT doc_key, pos, place_name, gmaps_url FROM firsts",
    "places_csv_roundtrip": f"""WITH {_LINKS} SELECT row_number() OVER (ORDER BY page_id, pos) AS place, x[2] AS place_name, x[1] AS gmaps_url
FROM links WHERE x[1] <> '' AND x[2] <> ''""",
    "place_page_picks": f"""WITH {_PLACE_PAGES}
SELECT page_id, 'Place ' || page_id AS name, 'Kind ' || page_id % 7 AS category, page_id % 5 || '.' || page_id % 10 AS avg_rating,
       page_id || ' reviews' AS total_reviews_text, 'Street ' || page_id AS address,
       CASE WHEN page_id % 2 = 0 THEN 'About it' ELSE '' END AS description, CASE WHEN page_id % 2 = 0 THEN 'a | b' || page_id ELSE '' END AS attributes,
       n_reviews, CASE WHEN last > 0 THEN 'User ' || last ELSE '' END AS last_user_name, CASE WHEN last > 0 THEN 'Text ' || last ELSE '' END AS last_text,
       CASE WHEN last > 0 THEN last || ' weeks ago' ELSE '' END AS last_time, CAST(CASE WHEN last > 0 THEN last % 6 ELSE -1 END AS BIGINT) AS last_rating
FROM placed""",
    "newest_page_wins": f"""WITH {_PLACE_PAGES}
SELECT 'p' || page_id AS doc_key, 'p' || page_id AS name, CASE WHEN page_id % 2 = 0 THEN 'About it' ELSE '' END AS description, n_reviews FROM placed""",
    "documents_json_roundtrip": f"""WITH {_PARAGRAPHS}, {_PAGE_PLACES}
SELECT doc_key AS file, row_number() OVER (PARTITION BY doc_key ORDER BY cards.pos) - 1 AS pos,
    coalesce(split_part(bold, chr(10), 1), 'Anonymous') AS user_name, stars AS rating, text
FROM firsts JOIN cards ON gmaps_url = url WHERE text <> ''""",
}

# ---- documents, files ------------------------------------------------------------------------

_REASON = """CASE WHEN b % 10 IN (3, 5) THEN 'malformed_json' WHEN b % 10 = 7 THEN 'review_not_object'
    WHEN b % 10 = 8 THEN 'place_info_not_object' ELSE '' END"""
_BLOCK_REVIEWS = f"""reviews AS (
  SELECT doc_id // {BLOCK_SIZE} AS b, 'block' || (doc_id // {BLOCK_SIZE}) AS file, doc_id, text, {_PHRASE} AS time,
         row_number() OVER (PARTITION BY doc_id // {BLOCK_SIZE} ORDER BY doc_id) - 1 AS pos,
         'User ' || (n_chars % 3) AS user_name, CAST((doc_id * 7) % 11 % 8 AS BIGINT) AS rating FROM documents),
ok AS (SELECT *, CASE WHEN rating BETWEEN 1 AND 5 THEN rating ELSE 0 END AS bucket FROM reviews WHERE {_REASON} = '')"""


def _block_fields() -> str:
    rating = _parse_rating("'4,' || (b % 10)")
    return f"""'Block ' || b AS place_name, '' AS place_description, '' AS place_category,
    'Parking: Free, WC' AS place_attributes, '' AS place_address,
    CAST(b * 1000 AS BIGINT) AS place_total_reviews_gmaps, {rating} AS place_avg_rating"""


ORACLE |= {
    "quarantine": f"WITH {_BLOCK_REVIEWS} SELECT DISTINCT file, {_REASON} AS reject_reason FROM reviews",
    "flatten_documents": f"WITH {_BLOCK_REVIEWS} SELECT file, pos, user_name, text, time, rating FROM ok",
    "place_fields_of_documents": f"WITH {_BLOCK_REVIEWS} SELECT DISTINCT file, {_block_fields()} FROM ok",
    "ratings_as_given": """
WITH r AS (SELECT o_orderkey, o_orderkey % 9 AS kind, o_orderkey % 6 AS star FROM orders)
SELECT o_orderkey,
       CAST(CASE kind WHEN 1 THEN star WHEN 3 THEN star WHEN 5 THEN 1 WHEN 8 THEN 0 ELSE -1 END AS BIGINT) AS rating,
       CAST(CASE WHEN kind IN (1, 2, 3) THEN star WHEN kind = 5 THEN 1 ELSE 0 END AS BIGINT) AS bucket,
       CASE kind WHEN 1 THEN star::VARCHAR WHEN 2 THEN star || '.5' WHEN 3 THEN star::VARCHAR WHEN 4 THEN 'good' WHEN 5 THEN 'true'
                 WHEN 6 THEN '9999999999' WHEN 7 THEN '[5]' ELSE 'none' END AS raw
FROM r""",
    "scan_document_files": f"""WITH {_BLOCK_REVIEWS}, d AS (SELECT DISTINCT file, {_REASON} AS reject_reason FROM reviews)
SELECT reject_reason, count(*) AS n_docs, count(*) AS n_files FROM d GROUP BY reject_reason""",
    "scan_written_documents": f"""WITH {_BLOCK_REVIEWS}, d AS (SELECT DISTINCT file, {_REASON} AS reject_reason FROM reviews)
SELECT reject_reason, count(*) AS n_docs, count(*) AS n_files FROM d GROUP BY reject_reason""",
    "curated_documents": f"""
WITH {_BLOCK_REVIEWS},
c AS (SELECT b, file, pos, bucket, rating, time, {_clean('user_name')} AS u, {_clean('text')} AS t FROM ok),
d AS (SELECT * FROM c WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY file, u, t ORDER BY pos) = 1),
{_sample('d', 20)}
SELECT {_anon('u')} AS user_id, rating AS user_rating, t AS review_text, {_reltime('time', _T)} AS review_time, {_block_fields()}
FROM d JOIN sampled USING (file, pos)""",
    "final_csv_roundtrip": ORACLE["curated_reviews"],
}

# The same results by other ways.
ORACLE |= {
    "curated_large_documents": ORACLE["curated_documents"],
    "committed_documents": ORACLE["documents_json_roundtrip"],
    "page_store_documents": ORACLE["collect_place_documents"],
}
