"""Queries of the scalar function library: numbers, text, paths and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as M
from ..functions import text as T
from ..registry import query, table


def _customers(spark, d):
    """Integers on both sides of zero, with divisors that are sometimes zero or negative."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, (k - 75).alias("a"), (k % 7 - 3).cast("long").alias("b"))


_INT = "SELECT c_custkey, c_custkey - 75 AS a, CAST(c_custkey % 7 - 3 AS BIGINT) AS b FROM customer"
_MOD = "(((a % nullif(b, 0)) + b) % nullif(b, 0))"


@query("int_floor_div_mod", f"SELECT c_custkey, CASE WHEN b <> 0 THEN (a - {_MOD}) // b END AS quotient, {_MOD} AS modulo, a % nullif(b, 0) AS remainder, b = 0 AS always_raises FROM ({_INT})")
def int_floor_div_mod(spark, d):
    a, b = F.col("a"), F.col("b")
    return _customers(spark, d).select("c_custkey", M.floor_div(a, b).alias("quotient"), M.floor_mod(a, b).alias("modulo"), M.truncated_remainder(a, b).alias("remainder"), (b == 0).alias("always_raises"))


@query("int_divmod_slots", f"SELECT CASE WHEN b <> 0 THEN (a - {_MOD}) // b END AS quotient, {_MOD} AS modulo, CAST(count(*) AS BIGINT) AS n FROM ({_INT}) GROUP BY 1, 2")
def int_divmod_slots(spark, d):
    a, b = F.col("a"), F.col("b")
    return _customers(spark, d).select(M.divmod_(a, b).alias("s")).groupBy("s.quotient", "s.modulo").agg(F.count("*").alias("n"))


@query("int_binary", f"SELECT c_custkey, a + b AS sum, a - b AS difference, a * b AS product, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge, a = b AS eq, a <> b AS ne, CAST(CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS BIGINT) AS cmp, a & b AS conj, a | b AS disj, xor(a, b) AS excl FROM ({_INT})")
def int_binary(spark, d):
    a, b = F.col("a"), F.col("b")
    return _customers(spark, d).select("c_custkey", (a + b).alias("sum"), (a - b).alias("difference"), (a * b).alias("product"), (a < b).alias("lt"), (a <= b).alias("le"), (a > b).alias("gt"), (a >= b).alias("ge"), (a == b).alias("eq"), (a != b).alias("ne"), M.spaceship(a, b).alias("cmp"), a.bitwiseAND(b).alias("conj"), a.bitwiseOR(b).alias("disj"), a.bitwiseXOR(b).alias("excl"))


@query("int_unary", f"SELECT c_custkey, a % 2 <> 0 AS odd, a % 2 = 0 AS even, a = 0 AS zero, a > 0 AS positive, a < 0 AS negative, a + 1 AS succ, a - 1 AS pred, abs(a) AS magnitude, CASE WHEN a IN (0, -1) THEN CAST(0 AS BIGINT) ELSE CAST(length(ltrim(format('{{:b}}', CASE WHEN a < 0 THEN -a - 1 ELSE a END), '0')) AS BIGINT) END AS bits, CAST(a AS VARCHAR) AS text, -a AS negated, -a - 1 AS inverted, CAST(a AS DOUBLE) AS floated FROM ({_INT})")
def int_unary(spark, d):
    a = F.col("a")
    return _customers(spark, d).select("c_custkey", (a % 2 != 0).alias("odd"), (a % 2 == 0).alias("even"), (a == 0).alias("zero"), (a > 0).alias("positive"), (a < 0).alias("negative"), (a + 1).alias("succ"), (a - 1).alias("pred"), F.abs(a).alias("magnitude"), M.bit_length(a).alias("bits"), a.cast("string").alias("text"), (-a).alias("negated"), F.bitwise_not(a).alias("inverted"), a.cast("double").alias("floated"))


@query("int_gcd_lcm", f"SELECT c_custkey, gcd(a, b) AS gcd, CAST(CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a * b) // gcd(a, b) END AS BIGINT) AS lcm FROM ({_INT})")
def int_gcd_lcm(spark, d):
    a, b = F.col("a"), F.col("b")
    g = M.gcd(a, b)
    return _customers(spark, d).select("c_custkey", g.alias("gcd"), F.when((a == 0) | (b == 0), 0).otherwise(M.floor_div(F.abs(a * b), g)).cast("long").alias("lcm"))


@query("int_between_clamp", "SELECT p_partkey, p_size BETWEEN 10 AND 20 AS inside, CAST(least(greatest(p_size, 10), 20) AS BIGINT) AS clamped, CAST(power(p_size, 3) AS BIGINT) AS cubed FROM part")
def int_between_clamp(spark, d):
    c = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", M.between(c, F.lit(10), F.lit(20)).alias("inside"), M.clamp(c, F.lit(10), F.lit(20)).cast("long").alias("clamped"), F.pow(c, 3).cast("long").alias("cubed"))


@query("int_mask_closure", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT m)), '|') AS masks FROM (SELECT l_orderkey, unnest([0, x, y, z, x | y, x | z, y | z, x | y | z]) AS m FROM (SELECT l_orderkey, CAST(1 << (min(l_linenumber) % 5) AS BIGINT) AS x, CAST(1 << (max(l_linenumber) % 5) AS BIGINT) AS y, CAST(16 AS BIGINT) AS z FROM lineitem GROUP BY 1)) GROUP BY 1")
def int_mask_closure(spark, d):
    n = F.col("l_linenumber")
    flag = lambda c: F.pow(F.lit(2), c % 5).cast("long")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(n).alias("lo"), F.max(n).alias("hi"))
    return g.select("l_orderkey", F.array_join(M.mask_values(F.array(flag(F.col("lo")), flag(F.col("hi")), F.lit(16).cast("long"))), "|").alias("masks"))


@query("flt_unary", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(x) AS BIGINT) AS floored, CAST(ceil(x) AS BIGINT) AS ceiled, CAST(trunc(x) AS BIGINT) AS truncated, x = 0 AS zero, x > 0 AS positive, isnan(x) AS nan, isfinite(x) AS finite, round(abs(x), 6) AS magnitude FROM (SELECT *, l_extendedprice - 30000 AS x FROM lineitem)")
def flt_unary(spark, d):
    x = F.col("l_extendedprice") - 30000
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(x).alias("floored"), F.ceil(x).alias("ceiled"), whole.alias("truncated"), (x == 0).alias("zero"), (x > 0).alias("positive"), F.isnan(x).alias("nan"), (~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"), F.round(F.abs(x), 6).alias("magnitude"))


@query("flt_binary", "SELECT c_custkey, round(c_acctbal + 0.5, 4) AS sum, round(c_acctbal * 2, 4) AS product, round(c_acctbal / 4, 4) AS quotient, c_acctbal < 100 AS lt, CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal > 0 THEN 1 ELSE 0 END::BIGINT AS cmp, CAST(floor(c_acctbal / 7) AS BIGINT) AS div, round(c_acctbal - 7 * floor(c_acctbal / 7), 4) AS modulo FROM customer")
def flt_binary(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(x + 0.5, 4).alias("sum"), F.round(x * 2, 4).alias("product"), F.round(x / 4, 4).alias("quotient"), (x < 100).alias("lt"), M.spaceship(x, F.lit(0)).alias("cmp"), F.floor(x / 7).alias("div"), F.round(x - 7 * F.floor(x / 7), 4).alias("modulo"))


@query("bool_nil_binary", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x AND y AS conj, x OR y AS disj, x <> y AS excl, NOT x AS negated, x = y AS same, y IS NULL AS nil FROM (SELECT *, l_tax > 0.04 AS x, l_discount > 0.05 AS y FROM lineitem)")
def bool_nil_binary(spark, d):
    x, y = F.col("l_tax") > 0.04, F.col("l_discount") > 0.05
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (x & y).alias("conj"), (x | y).alias("disj"), (x != y).alias("excl"), (~x).alias("negated"), (x == y).alias("same"), y.isNull().alias("nil"))


@query("str_binary", "SELECT p_partkey, p_name || ':' || p_type AS joined, repeat(p_brand, 2) AS repeated, p_brand = p_type AS eq, p_brand < p_type AS lt, p_brand <= p_type AS le, CAST(CASE WHEN p_brand < p_type THEN -1 WHEN p_brand > p_type THEN 1 ELSE 0 END AS BIGINT) AS cmp FROM part")
def str_binary(spark, d):
    x, y = F.col("p_brand"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(":"), y).alias("joined"), F.repeat(x, 2).alias("repeated"), (x == y).alias("eq"), (x < y).alias("lt"), (x <= y).alias("le"), M.spaceship(x, y).alias("cmp"))


@query("str_case", "SELECT p_partkey, lower(p_name) AS down, upper(p_name) AS up, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS capital, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS swapped FROM part")
def str_case(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("down"), F.upper("p_name").alias("up"), T.capitalize(F.col("p_type")).alias("capital"), T.swapcase_ascii(F.col("p_name")).alias("swapped"))


@query("str_sizes", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, text = '' AS empty, CAST(length(reverse(text)) AS BIGINT) AS reversed, CAST(unicode(text) AS BIGINT) AS ordinal FROM documents")
def str_sizes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), (t == "").alias("empty"), F.length(F.reverse(t)).cast("long").alias("reversed"), T.ordinal(t).alias("ordinal"))


_PADDED = "SELECT conv_id, turn, chr(9) || ' ' || text || ' ' || chr(13) || chr(10) AS x FROM conversations"


@query("str_strip", rf"SELECT conv_id, turn, regexp_replace(regexp_replace(x, '\A[\x00\x09-\x0D\x20]+', ''), '[\x00\x09-\x0D\x20]+\z', '') AS stripped, regexp_replace(x, '\A[\x00\x09-\x0D\x20]+', '') AS left_, regexp_replace(x, '[\x00\x09-\x0D\x20]+\z', '') AS right_, CAST(length(regexp_replace(x, '(\r\n|\n|\r)\z', '')) AS BIGINT) AS chomped, CAST(length(x) - 2 AS BIGINT) AS chopped FROM ({_PADDED})")
def str_strip(spark, d):
    c = table(spark, d, "conversations")
    x = F.concat(F.lit("\t "), F.col("text"), F.lit(" \r\n"))
    return c.select("conv_id", "turn", T.strip(x).alias("stripped"), T.lstrip(x).alias("left_"), T.rstrip(x).alias("right_"), F.length(T.chomp(x)).cast("long").alias("chomped"), F.length(T.chop(x)).cast("long").alias("chopped"))


@query("str_split_lines", r"SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers, CAST(len(list_filter(string_split(text, ','), lambda x: x <> '')) AS BIGINT) AS fields FROM documents")
def str_split_lines(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(F.split(t, " ")).cast("long").alias("words"), F.size(T.lines(t)).cast("long").alias("lines"), F.size(T.scan(t, "[0-9]+")).cast("long").alias("numbers"), F.size(F.filter(F.split(t, ","), lambda x: x != "")).cast("long").alias("fields"))


@query("str_split_trailing", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a||b' ELSE 'a' END AS fields, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS BIGINT) AS n FROM part")
def str_split_trailing(spark, d):
    k = F.col("p_partkey") % 3
    x = F.when(k == 0, "a,b,,").when(k == 1, "a,,b").otherwise("a,")
    fields = T.split_on(x, ",")
    return table(spark, d, "part").select("p_partkey", F.array_join(fields, "|").alias("fields"), F.size(fields).cast("long").alias("n"))


@query("str_chars_bytes", "SELECT p_partkey, array_to_string(string_split(p_brand, ''), '.') AS chars, hex(encode(p_brand)) AS bytes FROM part")
def str_chars_bytes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.characters(F.col("p_brand")), ".").alias("chars"), F.hex("p_brand").alias("bytes"))


@query("str_tests", "SELECT page_id, starts_with(url, 'https') AS starts, ends_with(url, '.html') AS ends, contains(url, 'example') AS includes, CAST(instr(url, 'example') - 1 AS BIGINT) AS idx, regexp_matches(url, '[0-9]{4}') AS matches FROM pages")
def str_tests(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", u.startswith("https").alias("starts"), u.endswith(".html").alias("ends"), u.contains("example").alias("includes"), (F.instr(u, "example") - 1).cast("long").alias("idx"), u.rlike("[0-9]{4}").alias("matches"))


@query("str_replace", "SELECT page_id, regexp_replace(url, '[0-9]', '#') AS sub, regexp_replace(url, '[0-9]', '#', 'g') AS gsub, translate(url, 'aeiou', '*****') AS tr, translate(url, '/:', '') AS deleted, CAST(length(url) - length(translate(url, '/', '')) AS BIGINT) AS slashes, regexp_replace(replace(url, '/', '  '), ' +', ' ', 'g') AS squeezed FROM pages")
def str_replace(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(u, r"\A([^0-9]*)[0-9]", "$1#").alias("sub"), F.regexp_replace(u, "[0-9]", "#").alias("gsub"), T.tr(u, "aeiou", "*").alias("tr"), T.delete(u, "/:").alias("deleted"), T.count_in(u, "/").alias("slashes"), T.squeeze_spaces(F.replace(u, F.lit("/"), F.lit("  "))).alias("squeezed"))


@query("str_pad", "SELECT p_partkey, rpad(p_brand, CAST(greatest(12, length(p_brand)) AS INTEGER), '.') AS left_, lpad(p_brand, CAST(greatest(12, length(p_brand)) AS INTEGER), '.') AS right_, repeat('.', greatest(12 - length(p_brand), 0) // 2) || p_brand || repeat('.', greatest(12 - length(p_brand), 0) - greatest(12 - length(p_brand), 0) // 2) AS centre FROM part")
def str_pad(spark, d):
    x = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", T.pad(x, 12, ".", "left").alias("left_"), T.pad(x, 12, ".", "right").alias("right_"), T.pad(x, 12, ".", "center").alias("centre"))


@query("str_partition", "SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN left(url, instr(url, '://') - 1) ELSE url END AS head, CASE WHEN instr(url, '://') > 0 THEN '://' ELSE '' END AS sep, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail, CASE WHEN contains(url, '/') THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE '' END AS rhead, regexp_extract(url, '([^/]*)$', 1) AS rtail FROM pages")
def str_partition(spark, d):
    p, r = T.partition(F.col("url"), "://"), T.partition(F.col("url"), "/", last=True)
    return table(spark, d, "pages").select("page_id", p["head"].alias("head"), p["separator"].alias("sep"), p["tail"].alias("tail"), r["head"].alias("rhead"), r["tail"].alias("rtail"))


@query("str_affixes", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS without_prefix, CASE WHEN ends_with(p_type, 'S') THEN left(p_type, length(p_type) - 1) ELSE p_type END AS without_suffix, coalesce(try_cast(substr(p_brand, 7) AS BIGINT), 0) AS number, CAST(0 AS BIGINT) AS zero FROM part")
def str_affixes(spark, d):
    return table(spark, d, "part").select("p_partkey", T.delete_prefix(F.col("p_brand"), "Brand#").alias("without_prefix"), T.delete_suffix(F.col("p_type"), "S").alias("without_suffix"), T.to_integer(T.delete_prefix(F.col("p_brand"), "Brand#")).alias("number"), T.to_integer(F.lit("x1")).alias("zero"))


@query("str_format", "SELECT p_partkey, printf('%05d', p_partkey) || '|' || p_brand || '|' || printf('%.2f', p_retailprice) AS text, 'part ' || p_partkey || ' is ' || p_type AS named FROM part")
def str_format(spark, d):
    named = F.replace(F.replace(F.lit("part %{k} is %{t}"), F.lit("%{k}"), F.col("p_partkey").cast("string")), F.lit("%{t}"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.format_string("%05d|%s|%.2f", "p_partkey", "p_brand", "p_retailprice").alias("text"), named.alias("named"))


_PATH = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS p FROM pages"


@query("path_parts", rf"SELECT page_id, CASE WHEN regexp_matches(p, '\A/+\z') THEN '/' ELSE regexp_extract(p, '([^/]*)/*\z', 1) END AS base, CASE WHEN regexp_replace(regexp_replace(p, '/*[^/]*/*\z', ''), '/+\z', '') <> '' THEN regexp_replace(regexp_replace(p, '/*[^/]*/*\z', ''), '/+\z', '') WHEN starts_with(p, '/') THEN '/' ELSE '.' END AS dir, regexp_extract(regexp_extract(p, '([^/]*)/*\z', 1), '\A.*[^.](\.[^.]+)\z', 1) AS ext, starts_with(p, '/') AS absolute, p || '/index' AS joined FROM ({_PATH})")
def path_parts(spark, d):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    df = table(spark, d, "pages").select("page_id", p.alias("p"))
    c = F.col("p")
    return df.select("page_id", T.basename(c).alias("base"), T.dirname(c).alias("dir"), T.extname(c).alias("ext"), T.is_absolute(c).alias("absolute"), F.concat_ws("/", c, F.lit("index")).alias("joined"))


@query("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(dayofweek(o_orderdate) AS BIGINT) AS wday, CAST(dayofyear(o_orderdate) AS BIGINT) AS yday, CAST(weekofyear(o_orderdate) AS BIGINT) AS cweek, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders")
def date_parts(spark, d):
    c = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(c).cast("long").alias("y"), F.month(c).cast("long").alias("m"), F.dayofmonth(c).cast("long").alias("d"), (F.dayofweek(c) - 1).cast("long").alias("wday"), F.dayofyear(c).cast("long").alias("yday"), F.weekofyear(c).cast("long").alias("cweek"), F.quarter(c).cast("long").alias("q"))


@query("date_shift_diff", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 1, '%Y-%m-%d') AS next_day, strftime(CAST(o_orderdate AS DATE) - 1, '%Y-%m-%d') AS prev_day, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH, '%Y-%m-%d') AS prev_year, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, strftime(last_day(CAST(o_orderdate AS DATE)), '%d') AS month_end FROM orders")
def date_shift_diff(spark, d):
    c = F.col("o_orderdate").cast("date")
    iso = lambda x: F.date_format(x, "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", iso(F.date_add(c, 1)).alias("next_day"), iso(F.date_sub(c, 1)).alias("prev_day"), iso(F.add_months(c, 1)).alias("next_month"), iso(F.add_months(c, -12)).alias("prev_year"), F.datediff(c, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_format(F.last_day(c), "dd").alias("month_end"))


@query("time_parts", "SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS rounded, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch FROM events")
def time_parts(spark, d):
    c = F.col("ts")
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", F.hour(c).cast("long").alias("h"), F.minute(c).cast("long").alias("mi"), F.floor(F.second(c)).cast("long").alias("s"), text(c).alias("text"), text(F.date_trunc("hour", c)).alias("rounded"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('second', ts))").cast("long").alias("epoch"))


@query("fold_cartesian", "WITH s AS (SELECT DISTINCT p_size % 3 - 1 AS x FROM part), t AS (SELECT DISTINCT p_partkey % 4 AS y FROM part), p AS (SELECT x // nullif(y, 0) AS q0, x, y FROM s, t WHERE y <> 0), v AS (SELECT DISTINCT CASE WHEN x % y <> 0 AND x < 0 THEN q0 - 1 ELSE q0 END AS v FROM p) SELECT CASE WHEN count(*) <= 8 THEN array_to_string(list_sort(list(v)), '|') END AS literals, CAST(min(v) AS BIGINT) AS lo, CAST(max(v) AS BIGINT) AS hi FROM v")
def fold_cartesian(spark, d):
    """x / y over two literal sets (32 pairs at most); pairs that raise are left out."""
    part = table(spark, d, "part")
    s = part.select((F.col("p_size") % 3 - 1).cast("long").alias("x")).distinct().agg(F.collect_list("x").alias("xs"))
    t = part.select((F.col("p_partkey") % 4).cast("long").alias("y")).distinct().agg(F.collect_list("y").alias("ys"))
    sets = s.join(F.broadcast(t))  # one row each
    sets = sets.where(F.size("xs") * F.size("ys") <= 32)
    v = sets.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).select(M.floor_div(F.col("x"), F.col("y")).alias("v")).where("v is not null").distinct()
    return v.agg(F.when(F.count("*") <= 8, F.array_join(F.array_sort(F.collect_list("v")), "|")).alias("literals"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("fold_guards", "SELECT c_custkey, CASE WHEN b <> 0 THEN a // b END IS NULL AS declined, CASE WHEN length(repeat('ab', c_custkey % 5000)) <= 4096 THEN CAST(length(repeat('ab', c_custkey % 5000)) AS BIGINT) END AS folded FROM (" + _INT + ")")
def fold_guards(spark, d):
    """Division by zero and texts over 4096 bytes are not folded."""
    a, b = F.col("a"), F.col("b")
    n = F.col("c_custkey") % 5000
    size = n * 2
    return _customers(spark, d).select("c_custkey", F.try_divide(a, b).isNull().alias("declined"), F.when(size <= 4096, F.length(F.repeat(F.lit("ab"), F.when(size <= 4096, n).otherwise(0).cast("int")))).cast("long").alias("folded"))


@query("fold_ranges", "SELECT p_partkey, CASE WHEN p_size % 12 - 3 > 0 AND p_size % 12 - 3 <= 16 THEN array_to_string(range(1, p_size % 12 - 2), '|') WHEN p_size % 12 - 3 <= 0 THEN '' END AS elements, CAST(CASE WHEN p_size % 12 - 3 >= 1 THEN 1 END AS BIGINT) AS first, CAST(CASE WHEN p_size % 12 - 3 >= 1 THEN p_size % 12 - 3 END AS BIGINT) AS last, CAST(greatest(p_size % 12 - 3, 0) AS BIGINT) AS n FROM part")
def fold_ranges(spark, d):
    """(1..n).to_a, first, last and size, for n from -3 to 8: empty below 1."""
    from ..functions.collections_ import first, last, upto

    r = upto(F.lit(1).cast("long"), (F.col("p_size") % 12 - 3).cast("long"))
    return table(spark, d, "part").select("p_partkey", F.when(F.size(r) <= 16, F.array_join(r, "|")).alias("elements"), first(r).alias("first"), last(r).alias("last"), F.size(r).cast("long").alias("n"))


@query("kernel_conversions", "SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS wrapped, try_cast(substr(p_brand, 7) AS BIGINT) AS number, coalesce(try_cast(substr(p_brand, 7) AS BIGINT) >= 0, false) AS non_negative, try_cast(p_type AS BIGINT) AS none FROM part")
def kernel_conversions(spark, d):
    """Array(x): empty for nil, else one element; Integer(x) of a refined text."""
    x = F.nullif(F.col("p_size") % 5, F.lit(0))
    number = F.substr("p_brand", F.lit(7)).try_cast("long")
    return table(spark, d, "part").select("p_partkey", F.size(F.when(x.isNull(), F.array().cast("array<int>")).otherwise(F.array(x))).cast("long").alias("wrapped"), number.alias("number"), F.coalesce(number >= 0, F.lit(False)).alias("non_negative"), F.col("p_type").try_cast("long").alias("none"))


@query("class_of_columns", "SELECT 'Integer' AS cls, 'p_partkey' AS col UNION ALL SELECT 'String', 'p_name' UNION ALL SELECT 'Float', 'p_retailprice' UNION ALL SELECT 'Integer', 'p_size'")
def class_of_columns(spark, d):
    from ..operators.profile import class_of

    kinds = dict(table(spark, d, "part").dtypes)
    return spark.createDataFrame([(class_of(kinds[c]), c) for c in ("p_partkey", "p_name", "p_retailprice", "p_size")], "cls string, col string")


@query("array_new", "SELECT p_partkey, CASE WHEN p_size <= 16 THEN CAST(p_size AS BIGINT) END AS n, CASE WHEN p_size <= 16 THEN array_to_string(list_transform(range(p_size), lambda x: 'x'), '') END AS filled FROM part")
def array_new(spark, d):
    n = F.col("p_size")
    made = F.array_repeat(F.lit("x"), F.least(n, F.lit(16)))
    return table(spark, d, "part").select("p_partkey", F.when(n <= 16, F.size(made)).cast("long").alias("n"), F.when(n <= 16, F.array_join(made, "")).alias("filled"))


@query("json_functions", "SELECT event_id, json_valid(props) AS valid, CAST(json_extract(props, '$.k') AS BIGINT) AS k, array_to_string(json_keys(props), '|') AS keys, json_type(props) AS kind FROM events")
def json_functions(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", v.isNotNull().alias("valid"), F.try_variant_get(v, "$.k", "long").alias("k"), F.array_join(F.json_object_keys("props"), "|").alias("keys"), F.when(F.json_object_keys("props").isNotNull(), "OBJECT").alias("kind"))


@query("json_shape", "SELECT 'k' AS key, 'BIGINT' AS type, CAST(count(*) AS BIGINT) AS n FROM events WHERE json_exists(props, '$.k')")
def json_shape(spark, d):
    """Key and type of the members that all values have together."""
    df = table(spark, d, "events").select(F.try_parse_json("props").alias("v"))
    whole = df.agg(F.expr("schema_of_variant_agg(v)").alias("s"), F.count("v").alias("n"))
    one = F.regexp_extract_all("s", F.lit(r"(\w+): (\w+)"), F.lit(1)), F.regexp_extract_all("s", F.lit(r"(\w+): (\w+)"), F.lit(2))
    return whole.select(F.explode(F.arrays_zip(one[0].alias("key"), one[1].alias("type"))).alias("p"), "n").select("p.key", "p.type", "n")


@query("csv_parse", "SELECT p_partkey, p_brand AS a, p_type AS b, CAST(p_size AS VARCHAR) AS c FROM part")
def csv_parse(spark, d):
    line = F.concat_ws(",", "p_brand", F.concat(F.lit('"'), "p_type", F.lit('"')), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.from_csv(line, F.lit("a string, b string, c string"), {"mode": "PERMISSIVE"}).alias("r")).select("p_partkey", "r.*")
