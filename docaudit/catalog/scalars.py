"""Registered scalar functions S1-S19 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import cells, dates, markup, text
from ..functions import fixed_values as V
from .adapters import sql

c = F.col


def amounts(spark, sf):
    """Amounts of lineitem written in the notations documents use."""
    return fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        """case (l_partkey + l_suppkey) % 10
             when 0 then concat('$', format_string('%,.2f', l_extendedprice))
             when 1 then translate(format_string('%,.2f', l_extendedprice), ',.', '.,')
             when 2 then concat(' ', translate(format_string('%,.2f', l_extendedprice), ',', ' '), ' ')
             when 3 then element_at(array('N/A', '-', ' none ', '없음', 'NULL', '', 'text'), cast(l_partkey % 7 + 1 as int))
             when 4 then cast(cast(l_extendedprice as decimal(18,2)) as string)
             when 5 then concat(l_linenumber, ',234,56')
             when 6 then format_string('%,d', cast(floor(l_extendedprice) as bigint))
             when 7 then concat('USD ', cast(l_quantity as bigint), ' pcs')
             when 8 then concat(l_partkey, ',', lpad(l_suppkey % 100, 2, '0'))
             else concat(l_partkey, '.', l_linenumber, '.', l_suppkey) end as t""",
    )


_AMOUNTS = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE (l_partkey + l_suppkey) % 10
        WHEN 0 THEN '$' || format('{:,.2f}', l_extendedprice)
        WHEN 1 THEN translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
        WHEN 2 THEN ' ' || replace(format('{:,.2f}', l_extendedprice), ',', ' ') || ' '
        WHEN 3 THEN ['N/A', '-', ' none ', '없음', 'NULL', '', 'text'][l_partkey % 7 + 1]
        WHEN 4 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
        WHEN 5 THEN l_linenumber || ',234,56'
        WHEN 6 THEN format('{:,}', CAST(floor(l_extendedprice) AS BIGINT))
        WHEN 7 THEN 'USD ' || CAST(l_quantity AS BIGINT) || ' pcs'
        WHEN 8 THEN l_partkey || ',' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')
        ELSE l_partkey || '.' || l_linenumber || '.' || l_suppkey END AS t
    FROM lineitem"""
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_BLANK = "('', 'n/a', 'na', 'none', 'null', '-', '없음', '미기재')"


def sql_text(t):
    return f"CASE WHEN lower(trim(coalesce({t}, ''))) NOT IN {_BLANK} THEN trim({t}) END"


def sql_number(t):
    tok = f"regexp_extract(replace({sql_text(t)}, ' ', ''), '-?[0-9.,]+')"
    return f"""TRY_CAST(CASE
        WHEN {tok} LIKE '%,%' AND {tok} LIKE '%.%' AND strpos(reverse({tok}), ',') < strpos(reverse({tok}), '.')
            THEN replace(replace({tok}, '.', ''), ',', '.')
        WHEN {tok} LIKE '%,%' AND {tok} LIKE '%.%' THEN replace({tok}, ',', '')
        WHEN {tok} LIKE '%,%' AND strpos(reverse({tok}), ',') IN (2, 3)
            THEN left({tok}, length({tok}) - strpos(reverse({tok}), ',')) || '.' || right({tok}, strpos(reverse({tok}), ',') - 1)
        ELSE replace({tok}, ',', '') END AS DOUBLE)"""


def date_texts(spark, sf):
    return fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """case o_orderkey % 8
             when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'yyyy/M/d')
             when 2 then date_format(o_orderdate, 'd.M.yyyy') when 3 then date_format(o_orderdate, 'dd/MM/yyyy')
             when 4 then date_format(o_orderdate, 'MM/dd/yyyy') when 5 then concat(' ', date_format(o_orderdate, 'yyyy-M-d'), ' ')
             when 6 then concat(date_format(o_orderdate, 'yyyy'), '-02-30') else 'Due after 30 days' end as t""",
    )


_DATES = """
    SELECT o_orderkey, CASE o_orderkey % 8
        WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%-m/%-d')
        WHEN 2 THEN strftime(o_orderdate, '%-d.%-m.%Y') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y')
        WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 5 THEN ' ' || strftime(o_orderdate, '%Y-%-m-%-d') || ' '
        WHEN 6 THEN strftime(o_orderdate, '%Y') || '-02-30' ELSE 'Due after 30 days' END AS t
    FROM orders"""
SQL_DATE = "CAST(try_strptime(trim({t}), ['%Y-%m-%d', '%Y/%m/%d', '%d.%m.%Y', '%d/%m/%Y', '%m/%d/%Y']) AS DATE)"
_PARSED = f"SELECT o_orderkey, t, {SQL_DATE.format(t='t')} AS d FROM dates"
_FORMS = (
    [o.format(s=s) for s in (".", "/", "-", " ") for o in
     ("%d{s}%m{s}%Y", "%m{s}%d{s}%Y", "%Y{s}%m{s}%d", "%-d{s}%-m{s}%Y", "%-m{s}%-d{s}%Y")]
    + [f.format(m=m) for m in ("%b", "%B") for f in
       ("{m} %d, %Y", "{m} %-d, %Y", "{m} %d %Y", "{m} %-d %Y", "%d {m} %Y", "%-d {m} %Y", "%-d-{m}-%Y", "%d-{m}-%Y")]
    + ["%Y년 %-m월 %-d일", "%Y년 %m월 %-d일"]
)
SQL_SPELLINGS = "[" + ", ".join(f"strftime(d, '{f}')" for f in _FORMS) + "]"
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_unescape(t):
    pairs = [("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"),
             ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")]
    for a, b in pairs:
        t = f"replace({t}, '{a}', {b})"
    return t


def descriptions(spark, sf):
    """Part names with quantities, prices and labels written into them."""
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey",
        """case p_partkey % 11
             when 0 then p_name when 1 then concat(p_name, ' (', p_size, ')') when 2 then concat(p_name, ' Qty. ', p_size)
             when 3 then concat(p_name, ' x ', p_size) when 4 then concat(p_name, ' (', p_size, ') 41.69')
             when 5 then concat(p_name, ' 822-79-9581 ', p_size, ' pcs. € 200') when 6 then concat(p_size, '.')
             when 7 then cast(p_size as string) when 8 then concat(p_name, ' ', p_size, '.5 units')
             when 9 then concat('v1.', p_size, 'ea ', p_name) else concat('qty:', p_size, ' x2 (', p_size, ')') end as t""",
    )


_DESCRIPTIONS = """
    SELECT p_partkey, CASE p_partkey % 11
        WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (' || p_size || ')' WHEN 2 THEN p_name || ' Qty. ' || p_size
        WHEN 3 THEN p_name || ' x ' || p_size WHEN 4 THEN p_name || ' (' || p_size || ') 41.69'
        WHEN 5 THEN p_name || ' 822-79-9581 ' || p_size || ' pcs. € 200' WHEN 6 THEN p_size || '.'
        WHEN 7 THEN CAST(p_size AS VARCHAR) WHEN 8 THEN p_name || ' ' || p_size || '.5 units'
        WHEN 9 THEN 'v1.' || p_size || 'ea ' || p_name ELSE 'qty:' || p_size || ' x2 (' || p_size || ')' END AS t
    FROM part"""
_CUR = "[€$£¥₩]|(?:usd|eur|gbp|krw|jpy|cad|aud|chf|cny)\\b|원"
_UNIT = "(?:pcs?|pieces?|ea|units?|hrs?|hours?|days?|개)\\b\\.?"
_QTY_RE = ["\\((\\d+(?:\\.\\d+)?)\\)\\s*$", "(?i)\\bqty\\.?\\s*[:x]?\\s*(\\d+(?:\\.\\d+)?)",
           "(?i)\\bx\\s*(\\d+(?:\\.\\d+)?)\\s*$", "\\((\\d+(?:\\.\\d+)?)\\)"]
_LABELS = ["Sub Total", "TOTAL:", "Total Station", "Sales  Tax", "VAT", "합계", "Shipping & Handling", "Discount", "Amount Due:"]


def label_rows(spark, sf):
    labels = ", ".join(f"'{x}'" for x in _LABELS)
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey",
        f"array(if(p_partkey % 3 = 0, element_at(array({labels}), cast(p_partkey % {len(_LABELS)} + 1 as int)), p_name),"
        " cast(p_size as string)) as row_cells",
    )


def _s17(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.first_line(c("text"), 120).alias("head"),
        text.first_line(c("text"), 70, ellipsis=True).alias("short"),
    )


def _pages(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.text_page(c("text"), 100, 500).alias("p")).select(
        "doc_id", "p.*"
    )


QUERIES = {
    "s1_to_text": lambda s, d: amounts(s, d).select(*_KEYS.split(", "), text.to_text(c("t")).alias("v")),
    "s2_to_number": lambda s, d: amounts(s, d).select(*_KEYS.split(", "), text.to_number(c("t")).alias("v")),
    "s3_parse_date": lambda s, d: date_texts(s, d).select(
        "o_orderkey", dates.parse_date(c("t")).cast("string").alias("v")),
    "s4_normalize": lambda s, d: fx.table(s, d, "documents").select("doc_id", F.md5(markup.normalize(c("text"))).alias("v")),
    "s5_unescape_html": lambda s, d: fx.table(s, d, "pages").select("page_id", F.md5(markup.unescape_html(c("html"))).alias("v")),
    "s6_date_variants": lambda s, d: date_texts(s, d).select(
        "o_orderkey", F.array_join(dates.date_variants(c("t")), "|").alias("v")),
    "s7_number_variants": lambda s, d: fx.table(s, d, "lineitem").select(
        *_KEYS.split(", "), F.array_join(F.array_sort(dates.number_variants(
            F.when(c("l_partkey") % 3 == 0, F.floor(c("l_extendedprice")).cast("double"))
            .when(c("l_partkey") % 3 == 1, c("l_extendedprice") * 1e9 + F.element_at(
                F.array(F.lit(0.125), F.lit(0.005), F.lit(0.375)), (c("l_suppkey") % 3 + 1).cast("int")))
            .otherwise(c("l_extendedprice")))), "|").alias("v")),
    "s8_flatten_markup": lambda s, d: fx.table(s, d, "documents").select("doc_id", F.md5(markup.flatten_markup(c("text"))).alias("v")),
    "s9_head_tail_excerpt": lambda s, d: fx.table(s, d, "documents").select(
        "doc_id", F.md5(text.head_tail_excerpt(c("text"), 500)).alias("v")),
    "s10_text_page": _pages,
    "s11_embedded_quantities": lambda s, d: descriptions(s, d).select(
        "p_partkey", F.transform(cells.embedded_quantities(c("t")), lambda x: x.cast("decimal(18,2)").cast("string")).alias("q")
    ).select("p_partkey", F.array_join("q", "|").alias("v")),
    "s12_is_number_cell": lambda s, d: amounts(s, d).select(*_KEYS.split(", "), cells.is_number_cell(c("t")).alias("v")),
    "s13_currency_unit": lambda s, d: descriptions(s, d).select(
        "p_partkey", cells.has_currency(c("t")).alias("currency"), cells.has_unit(c("t")).alias("unit")),
    "s14_item_number_cell": lambda s, d: descriptions(s, d).select(
        "p_partkey", cells.item_number_cell(c("t")).cast("long").alias("v")),
    "s15_is_summary_row": lambda s, d: label_rows(s, d).select("p_partkey", cells.is_summary_row(c("row_cells")).alias("v")),
    "s16_has_quantity_text": lambda s, d: descriptions(s, d).select("p_partkey", cells.has_quantity_text(c("t")).alias("v")),
    "s17_first_line": _s17,
    "s18_labels": lambda s, d: fx.inv_documents(s, d).select(
        "id", text.status_label(c("status")).alias("status"), text.doc_type_label(c("doc_type")).alias("doc_type")),
    "s19_error_target": lambda s, d: fx.inv_errors(s, d).select(
        "id", text.error_target(F.when(c("id") % 2 == 0, F.concat(F.lit("line_items["), c("id").cast("string"), F.lit("]")))
                                .when(c("id") % 3 == 0, "total_amount").otherwise(c("field"))).alias("v")),
}

_STATUS = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.STATUS_LABELS.items()) + " END"
_TRIM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
_FIRST = "regexp_split_to_array({t}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')[1]"

ORACLES = {
    "s1_to_text": sql(f"SELECT {_KEYS}, {sql_text('t')} AS v FROM amounts", amounts=_AMOUNTS),
    "s2_to_number": sql(f"SELECT {_KEYS}, {sql_number('t')} AS v FROM amounts", amounts=_AMOUNTS),
    "s3_parse_date": sql("SELECT o_orderkey, CAST(d AS VARCHAR) AS v FROM parsed", dates=_DATES, parsed=_PARSED),
    "s4_normalize": f"SELECT doc_id, md5(lower(regexp_replace({sql_unescape('text')}, '{_SPACES}+', ' ', 'g'))) AS v FROM documents",
    "s5_unescape_html": f"SELECT page_id, md5({sql_unescape('html')}) AS v FROM pages",
    "s6_date_variants": sql(
        f"SELECT o_orderkey, CASE WHEN d IS NULL THEN t ELSE array_to_string({SQL_SPELLINGS}, '|') END AS v FROM parsed",
        dates=_DATES, parsed=_PARSED),
    "s7_number_variants": f"""
        SELECT {_KEYS}, array_to_string(list_sort(list_distinct(list_concat(f, list_transform(f, lambda s: translate(s, ',.', '.,'))))), '|') AS v
        FROM (SELECT {_KEYS}, list_filter([format('{{:.2f}}', x), format('{{:,.2f}}', x), printf('%g', x),
                     CASE WHEN w THEN CAST(CAST(x AS BIGINT) AS VARCHAR) END,
                     CASE WHEN w THEN format('{{:,}}', CAST(x AS BIGINT)) END,
                     CASE WHEN w THEN CAST(x AS BIGINT) || '.00' END], lambda s: s IS NOT NULL) AS f
              FROM (SELECT *, x = floor(x) AS w FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN floor(l_extendedprice)
                    WHEN l_partkey % 3 = 1 THEN l_extendedprice * 1e9::DOUBLE + [0.125, 0.005, 0.375][l_suppkey % 3 + 1]::DOUBLE
                    ELSE l_extendedprice END AS x FROM lineitem)))""",
    "s8_flatten_markup": f"""SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '[|#*`_]+', ' ', 'g'),
                              '{_SPACES}+', ' ', 'g')))) AS v FROM documents""",
    "s9_head_tail_excerpt": """SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE
        left(text, 300) || chr(10) || chr(10) || '...[중략]...' || chr(10) || chr(10) || right(text, 200) END) AS v FROM documents""",
    "s10_text_page": """SELECT doc_id, length(text) AS total_chars, 100 AS "offset", length(substr(text, 101, 500)) AS returned_chars,
        100 + length(substr(text, 101, 500)) < length(text) AS has_more, substr(text, 101, 500) AS chunk FROM documents""",
    "s11_embedded_quantities": sql(
        "SELECT p_partkey, array_to_string(list_transform(list_filter(["
        + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in _QTY_RE)
        + "], lambda x: x IS NOT NULL), lambda x: CAST(CAST(x AS DECIMAL(18,2)) AS VARCHAR)), '|') AS v FROM descriptions",
        descriptions=_DESCRIPTIONS),
    "s12_is_number_cell": sql(
        f"""SELECT {_KEYS}, trim(t) <> '' AND regexp_matches(t,
            '(?i)^\\s*(?:{_CUR})?\\s*[-+]?\\d[\\d.,\\s]*\\s*(?:(?:{_CUR})|(?:{_UNIT}))?\\s*$') AS v FROM amounts""", amounts=_AMOUNTS),
    "s13_currency_unit": sql(
        f"SELECT p_partkey, regexp_matches(t, '(?i){_CUR}') AS currency, regexp_matches(t, '(?i){_UNIT}') AS unit FROM descriptions",
        descriptions=_DESCRIPTIONS),
    "s14_item_number_cell": sql(
        "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(t, '^\\s*(\\d{1,4})\\.?\\s*$', 1), '') AS BIGINT) AS v FROM descriptions",
        descriptions=_DESCRIPTIONS),
    "s15_is_summary_row": f"""
        SELECT p_partkey, regexp_matches(a || ' ' || b, '(?i)\\b(?:sub\\s*total|sales\\s*tax|vat|shipping|handling|total\\s*due|amount\\s*due|balance\\s*due|grand\\s*total)\\b|합계|소계|부가세|공급가액')
            OR rtrim(lower(trim(a)), ':') IN ({', '.join(f"'{x}'" for x in V.SUMMARY_LABELS)}) AS v
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {_LABELS}[p_partkey % {len(_LABELS)} + 1] ELSE p_name END AS a,
                     CAST(p_size AS VARCHAR) AS b FROM part)""",
    "s16_has_quantity_text": sql(
        """SELECT p_partkey, regexp_matches(t,
           '(?i)(?:^|[^\\w.])\\d+(?:[.,]\\d+)?\\s*(?:pcs\\b\\.?|pc\\b\\.?|pieces?\\b|units?\\b|ea\\b\\.?|개)') AS v FROM descriptions""",
        descriptions=_DESCRIPTIONS),
    "s17_first_line": f"""
        SELECT doc_id, substr({_FIRST.replace('{t}', 'text')}, 1, 120) AS head,
               CASE WHEN trim(text, {_TRIM}) = '' THEN '(내용 없음)'
                    WHEN length({_FIRST.replace('{t}', f'trim(text, {_TRIM})')}) > 70
                    THEN substr({_FIRST.replace('{t}', f'trim(text, {_TRIM})')}, 1, 70) || '…'
                    ELSE {_FIRST.replace('{t}', f'trim(text, {_TRIM})')} END AS short
        FROM documents""",
    "s18_labels": sql(
        f"""SELECT id, {_STATUS} AS status, CASE doc_type WHEN 'INVOICE' THEN '송장' WHEN 'RECEIPT' THEN '영수증' END AS doc_type
            FROM inv_documents""", "inv_documents"),
    "s19_error_target": sql(
        """SELECT id, CASE WHEN id % 2 = 0 THEN 'line_items' WHEN id % 3 = 0 THEN 'total_amount' END AS v FROM inv_errors""",
        "inv_errors"),
}
