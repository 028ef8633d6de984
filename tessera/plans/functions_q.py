"""Scalar function families: one query per family of pyspark.sql.functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.sources.tables import read


def t(spark, sf_dir, name):
    return read(spark, sf_dir, name)


def r(col, d=6, name=None):
    c = F.round(col.cast("double"), d)
    return c.alias(name) if name else c


@register("fn_normal", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'X') AS status,
       CASE WHEN isnan(CASE WHEN o_orderstatus = 'F' THEN 'NaN'::DOUBLE ELSE o_totalprice END) THEN -1.0
            ELSE CASE WHEN o_orderstatus = 'F' THEN 'NaN'::DOUBLE ELSE o_totalprice END END AS nanvl_price,
       greatest(o_totalprice, 100000.0) AS floor_price, least(o_totalprice, 300000.0) AS cap_price,
       nullif(o_orderpriority, '5-LOW') AS prio, 42 AS answer
FROM orders""")
def q_fn_normal(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    nanp = F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey",
                    F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("X")).alias("status"),
                    F.nanvl(nanp, F.lit(-1.0)).alias("nanvl_price"),
                    F.greatest("o_totalprice", F.lit(100000.0)).alias("floor_price"),
                    F.least("o_totalprice", F.lit(300000.0)).alias("cap_price"),
                    F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"), F.lit(42).alias("answer"))


@register("fn_math", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 2) AS round2, round_even(l_quantity / 4, 1) AS bround1,
       round(sqrt(l_extendedprice), 6) AS sqrt_, round(cbrt(l_extendedprice), 6) AS cbrt_, round(exp(l_discount), 6) AS exp_,
       round(ln(l_extendedprice), 6) AS ln_, round(log10(l_extendedprice), 6) AS log10_, round(log2(l_quantity), 6) AS log2_,
       round(log(l_extendedprice) / log(3), 6) AS log3_, round(pow(l_quantity, 1.5), 6) AS pow_,
       round(sin(l_discount), 6) AS sin_, round(cos(l_tax), 6) AS cos_, round(atan2(l_quantity, l_extendedprice), 6) AS atan2_,
       round(degrees(l_discount), 6) AS deg_, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS floor_, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS ceil_,
       abs(l_discount - 0.05) AS abs_, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sign_, l_orderkey % 7 AS mod_,
       upper(hex(l_orderkey)) AS hex_, bin(l_partkey) AS bin_, CAST(factorial(CAST(l_quantity AS INTEGER) % 10) AS BIGINT) AS fact_
FROM lineitem""")
def q_fn_math(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    p, q, d = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(p / 7, 2).alias("round2"), F.bround(q / 4, 1).alias("bround1"),
        r(F.sqrt(p), name="sqrt_"), r(F.cbrt(p), name="cbrt_"), r(F.exp(d), name="exp_"), r(F.log(p), name="ln_"),
        r(F.log10(p), name="log10_"), r(F.log2(q), name="log2_"), r(F.log(3.0, p), name="log3_"),
        r(F.pow(q, 1.5), name="pow_"), r(F.sin(d), name="sin_"), r(F.cos("l_tax"), name="cos_"),
        r(F.atan2(q, p), name="atan2_"), r(F.degrees(d), name="deg_"), F.floor(p / 1000).alias("floor_"),
        F.ceil(p / 1000).alias("ceil_"), F.abs(d - 0.05).alias("abs_"), F.signum(d - 0.05).alias("sign_"),
        F.pmod("l_orderkey", F.lit(7)).alias("mod_"), F.hex("l_orderkey").alias("hex_"), F.bin("l_partkey").alias("bin_"),
        F.factorial(q.cast("int") % 10).alias("fact_"))


@register("fn_string", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_name || '  ') AS trimmed,
       ltrim('xx' || p_type, 'x') AS ltrimmed, lpad(CAST(p_size AS VARCHAR), 5, '0') AS lpadded, rpad(p_type, 10, '.') AS rpadded,
       split_part(p_name, ' ', 1) AS first_word, substr(p_name, 2, 3) AS sub, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked,
       regexp_extract(p_name, '(\\w+) (\\w+)', 2) AS second_word, printf('%s-%05d', p_brand, p_size) AS formatted,
       levenshtein(p_name, p_type) AS lev, to_base64(encode(p_name)) AS b64, length(p_name) AS len, reverse(p_name) AS rev,
       repeat(p_type, 2) AS rep, instr(p_name, 'e') AS pos_e, concat_ws('|', p_brand, p_type) AS joined,
       translate(p_name, 'abc', 'xyz') AS translated, ascii(p_name) AS first_code, replace(p_name, ' ', '_') AS underscored
FROM part""")
def q_fn_string(spark, sf_dir):
    pt = t(spark, sf_dir, "part")
    n = F.col("p_name")
    return pt.select(
        "p_partkey", F.upper(n).alias("up"), F.lower("p_brand").alias("low"),
        F.trim(F.concat(F.lit("  "), n, F.lit("  "))).alias("trimmed"),
        F.ltrim(F.concat(F.lit("xx"), F.col("p_type")), F.lit("x")).alias("ltrimmed"),
        F.lpad(F.col("p_size").cast("string"), 5, "0").alias("lpadded"), F.rpad("p_type", 10, ".").alias("rpadded"),
        F.split(n, " ").getItem(0).alias("first_word"), F.substring(n, 2, 3).alias("sub"),
        F.regexp_replace(n, "[aeiou]", "*").alias("masked"), F.regexp_extract(n, r"(\w+) (\w+)", 2).alias("second_word"),
        F.format_string("%s-%05d", "p_brand", "p_size").alias("formatted"),
        F.levenshtein(n, F.col("p_type")).alias("lev"), F.base64(n).alias("b64"), F.length(n).alias("len"),
        F.reverse(n).alias("rev"), F.repeat("p_type", 2).alias("rep"), F.instr(n, "e").alias("pos_e"),
        F.concat_ws("|", "p_brand", "p_type").alias("joined"), F.translate(n, "abc", "xyz").alias("translated"),
        F.ascii(n).alias("first_code"), F.replace(n, F.lit(" "), F.lit("_")).alias("underscored"))


@register("fn_string_text", """
SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, 'e', '')) AS n_e,
       len(string_split(text, chr(10))) AS n_lines, md5(text) AS digest,
       regexp_matches(text, '[0-9]{3}') AS has_3digits
FROM documents""")
def q_fn_string_text(spark, sf_dir):
    """String functions over whole document texts."""
    txt = F.col("text")
    return t(spark, sf_dir, "documents").select(
        "doc_id", F.length(txt).alias("n_chars"), (F.length(txt) - F.length(F.replace(txt, F.lit("e"), F.lit("")))).alias("n_e"),
        F.size(F.split(txt, "\n")).alias("n_lines"), F.md5(txt).alias("digest"), txt.rlike("[0-9]{3}").alias("has_3digits"))


@register("fn_datetime", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') AS ym,
       date_trunc('month', o_orderdate) AS month_start, CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS plus30,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS plus2m,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days_left,
       year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS dow, quarter(o_orderdate) AS q,
       weekofyear(o_orderdate) AS woy, dayofyear(o_orderdate) AS doy, last_day(CAST(o_orderdate AS DATE)) AS eom,
       CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s, make_date(year(o_orderdate), 1, 1) AS year_start,
       o_orderdate + INTERVAL 36 HOUR AS plus36h
FROM orders""")
def q_fn_datetime(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    ts = F.col("o_orderdate")
    d = F.to_date(ts)
    return o.select(
        "o_orderkey", d.alias("d"), F.date_format(ts, "yyyy-MM").alias("ym"), F.date_trunc("month", ts).alias("month_start"),
        F.date_add(d, 30).cast("timestamp_ntz").alias("plus30"), F.add_months(d, 2).alias("plus2m"),
        F.datediff(F.lit("2002-01-01").cast("date"), d).alias("days_left"), F.year(ts).alias("y"), F.month(ts).alias("m"),
        F.dayofweek(ts).alias("dow"), F.quarter(ts).alias("q"), F.weekofyear(ts).alias("woy"), F.dayofyear(ts).alias("doy"),
        F.last_day(d).alias("eom"), F.unix_timestamp(ts.cast("timestamp")).alias("epoch_s"),
        F.make_date(F.year(ts), F.lit(1), F.lit(1)).alias("year_start"),
        (ts + F.expr("INTERVAL 36 HOURS")).alias("plus36h"))


@register("fn_datetime_zones")
def q_fn_datetime_zones(spark, sf_dir):
    """Zone conversions and Spark-only forms (row check)."""
    ev = t(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return ev.select("event_id", F.from_utc_timestamp(ts, "America/New_York").alias("ny"),
                     F.to_utc_timestamp(ts, "Asia/Tokyo").alias("from_tokyo"),
                     F.months_between(ts, F.lit("2023-01-01").cast("timestamp")).alias("months"),
                     F.next_day(F.to_date(ts), "Mon").alias("next_monday"),
                     F.window_time(F.window(ts, "1 hour")).alias("window_end"))


@register("fn_array", """
SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS max_v, CAST(list_min(embedding) AS DOUBLE) AS min_v,
       len(embedding) AS size_, len(list_filter(embedding, lambda x: x > 0)) AS n_pos,
       list_sort([label, CAST(vec_id % 5 AS INTEGER), 3]) AS sorted_arr,
       list_sort(list_distinct(list_concat([label, 1, 2], [2, 3, label]))) AS union_,
       list_contains([label, 2], 2) AS has2, list_slice(list_transform(embedding, lambda x: CAST(x AS DOUBLE) > 0), 1, 3) AS first3_pos,
       list_position([3, label, 5], label) AS pos_label, len(list_filter(embedding, lambda x: x > 1)) > 0 AS any_gt1,
       list_sort(flatten([[label], [CAST(vec_id % 3 AS INTEGER)]])) AS flat,
       generate_series(1, label + 1) AS seq_, list_reverse([1, 2, label]) AS rev
FROM embeddings""")
def q_fn_array(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    emb, lab = F.col("embedding"), F.col("label")
    return e.select(
        "vec_id", F.array_max(emb).cast("double").alias("max_v"), F.array_min(emb).cast("double").alias("min_v"),
        F.size(emb).alias("size_"), F.size(F.filter(emb, lambda x: x > 0)).alias("n_pos"),
        F.array_sort(F.array(lab, (F.col("vec_id") % 5).cast("int"), F.lit(3))).alias("sorted_arr"),
        F.array_sort(F.array_union(F.array(lab, F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), lab))).alias("union_"),
        F.array_contains(F.array(lab, F.lit(2)), 2).alias("has2"),
        F.slice(F.transform(emb, lambda x: x > 0), 1, 3).alias("first3_pos"),
        F.array_position(F.array(F.lit(3), lab, F.lit(5)), lab).alias("pos_label"),
        F.exists(emb, lambda x: x > 1).alias("any_gt1"),
        F.array_sort(F.flatten(F.array(F.array(lab), F.array((F.col("vec_id") % 3).cast("int"))))).alias("flat"),
        F.sequence(F.lit(1).cast("long"), (lab + 1).cast("long")).alias("seq_"),
        F.reverse(F.array(F.lit(1), F.lit(2), lab)).alias("rev"))


@register("fn_map", """
SELECT event_id, list_sort(map_keys(MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)})) AS keys_,
       MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)}['type'] AS type_,
       len(map_keys(map_from_entries([{'k': 'a', 'v': event_id}, {'k': 'b', 'v': user_id}]))) AS n_entries,
       list_sort(map_values(MAP {'x': CAST(event_id AS VARCHAR), 'y': event_type})) AS values_,
       CASE WHEN value > 25 THEN 1 ELSE 0 END AS n_big
FROM events""")
def q_fn_map(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    entries = F.map_from_entries(F.array(F.struct(F.lit("a").alias("k"), F.col("event_id").alias("v")),
                                         F.struct(F.lit("b").alias("k"), F.col("user_id").alias("v"))))
    vals = F.map_concat(F.create_map(F.lit("x"), F.col("event_id").cast("string")),
                        F.create_map(F.lit("y"), F.col("event_type")))
    big = F.map_filter(F.create_map(F.lit("v"), F.col("value")), lambda k, v: v > 25)
    return ev.select("event_id", F.array_sort(F.map_keys(m)).alias("keys_"), m["type"].alias("type_"),
                     F.size(F.map_keys(entries)).alias("n_entries"), F.array_sort(F.map_values(vals)).alias("values_"),
                     F.size(big).alias("n_big"))


@register("fn_json", """
SELECT event_id, json_extract_string(props, '$.k') AS k_str, CAST(json_extract(props, '$.k') AS INTEGER) AS k_int,
       to_json({'id': event_id, 'k': CAST(json_extract(props, '$.k') AS INTEGER)}) AS as_json,
       json_extract_string(props, '$.k') AS k_tuple, json_array_length('[' || props || ',1]') AS arr_len
FROM events""")
def q_fn_json(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    parsed = F.from_json("props", "k INT")
    return ev.select("event_id", F.get_json_object("props", "$.k").alias("k_str"), parsed["k"].alias("k_int"),
                     F.to_json(F.named_struct(F.lit("id"), F.col("event_id"), F.lit("k"), parsed["k"])).alias("as_json"),
                     F.json_tuple("props", "k").alias("k_tuple"),
                     F.json_array_length(F.concat(F.lit("["), F.col("props"), F.lit(",1]"))).alias("arr_len"))


@register("fn_csv", """
SELECT o_orderkey, CAST(split_part(line, ',', 1) AS BIGINT) AS key_back, split_part(line, ',', 2) AS status,
       CAST(split_part(line, ',', 3) AS DOUBLE) AS price, line AS csv_line
FROM (SELECT o_orderkey, concat_ws(',', o_orderkey, o_orderstatus, o_totalprice) AS line FROM orders)""")
def q_fn_csv(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    line = F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))
    parsed = F.from_csv(line, "key_back BIGINT, status STRING, price DOUBLE")
    return o.select("o_orderkey", parsed.alias("p"), line.alias("csv_line")) \
        .select("o_orderkey", "p.key_back", "p.status", "p.price", "csv_line")


@register("fn_struct", """
SELECT c_custkey, c_name AS s_name, c_acctbal AS s_bal, to_json({'name': c_name, 'seg': c_mktsegment}) AS as_json
FROM customer""")
def q_fn_struct(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    s = F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    ns = F.named_struct(F.lit("name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment"))
    return c.select("c_custkey", s["name"].alias("s_name"), s["bal"].alias("s_bal"), F.to_json(ns).alias("as_json"))


@register("fn_bitwise", """
SELECT o_orderkey, bit_count(o_orderkey) AS ones, (o_orderkey >> 3) & 1 AS bit3, o_orderkey << 2 AS shl,
       o_orderkey >> 1 AS shr, o_orderkey >> 4 AS shru, ~o_orderkey AS inv
FROM orders""")
def q_fn_bitwise(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", F.bit_count(k).cast("bigint").alias("ones"), F.bit_get(k, F.lit(3)).cast("bigint").alias("bit3"),
        F.shiftleft(k, 2).alias("shl"), F.shiftright(k, 1).alias("shr"), F.shiftrightunsigned(k, 4).alias("shru"),
        F.bitwise_not(k).alias("inv"))


@register("fn_hash_misc", """
SELECT p_partkey, md5(p_name) AS md5_, sha256(p_name) AS sha256_, sha1(p_name) AS sha1_ FROM part""")
def q_fn_hash_misc(spark, sf_dir):
    n = F.col("p_name")
    return t(spark, sf_dir, "part").select("p_partkey", F.md5(n).alias("md5_"), F.sha2(n, 256).alias("sha256_"),
                                           F.sha1(n).alias("sha1_"))


@register("fn_hash_spark")
def q_fn_hash_spark(spark, sf_dir):
    """Spark-specific hashes, AES round trip and assertions (row check)."""
    n = F.col("p_name")
    key = F.lit("0123456789abcdef")
    enc = F.aes_encrypt(n, key, F.lit("GCM"))
    return t(spark, sf_dir, "part").select(
        "p_partkey", F.crc32(n).alias("crc"), F.xxhash64(n).alias("xx"), F.hash(n).alias("murmur"),
        (F.aes_decrypt(enc, key, F.lit("GCM")).cast("string") == n).alias("aes_roundtrip"),
        F.assert_true(F.col("p_size") > 0).alias("checked"))


@register("fn_predicate", """
SELECT p_partkey, (CASE WHEN p_size > 25 THEN NULL ELSE p_type END) IS NOT DISTINCT FROM
       (CASE WHEN p_size > 40 THEN NULL ELSE p_type END) AS eq_null,
       (CASE WHEN p_size > 25 THEN NULL ELSE p_type END) IS NOT NULL AS not_null,
       p_name ILIKE '%Ring%' AS ilike_, p_name LIKE '%!_%' ESCAPE '!' AS like_esc,
       regexp_matches(p_name, 'w[a-z]+t') AS regexp_, starts_with(p_brand, 'Brand#1') AS starts
FROM part""")
def q_fn_predicate(spark, sf_dir):
    tp = F.when(F.col("p_size") <= 25, F.col("p_type"))
    tp2 = F.when(F.col("p_size") <= 40, F.col("p_type"))
    n = F.col("p_name")
    return t(spark, sf_dir, "part").select(
        "p_partkey", F.equal_null(tp, tp2).alias("eq_null"), F.isnotnull(tp).alias("not_null"),
        F.ilike(n, F.lit("%Ring%")).alias("ilike_"), F.like(n, F.lit("%!_%"), F.lit("!")).alias("like_esc"),
        F.regexp(n, F.lit("w[a-z]+t")).alias("regexp_"), F.startswith("p_brand", F.lit("Brand#1")).alias("starts"))


@register("fn_xpath", """
SELECT page_id, CAST(page_id AS INTEGER) AS id, url, CAST(length(html) AS BIGINT) AS n,
       [CAST(page_id AS VARCHAR), url, CAST(length(html) AS VARCHAR)] AS texts FROM pages""")
def q_fn_xpath(spark, sf_dir):
    """XPath reads from an XML document made per page."""
    p = t(spark, sf_dir, "pages")
    xml = F.concat(F.lit("<doc><id>"), F.col("page_id").cast("string"), F.lit("</id><url>"),
                   F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</url><n>"),
                   F.length("html").cast("string"), F.lit("</n></doc>"))
    return p.select("page_id", F.xpath_int(xml, F.lit("/doc/id")).alias("id"),
                    F.xpath_string(xml, F.lit("/doc/url")).alias("url"),
                    F.xpath_long(xml, F.lit("/doc/n")).alias("n"),
                    F.xpath(xml, F.lit("/doc/*/text()")).alias("texts"))


@register("fn_url", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
       CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page,
       regexp_extract(url, '^([a-z]+)://', 1) AS protocol, TRUE AS roundtrip
FROM pages""")
def q_fn_url(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select(
        "page_id", F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"),
        F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"), F.parse_url(u, F.lit("PROTOCOL")).alias("protocol"),
        (F.url_decode(F.url_encode(u)) == u).alias("roundtrip"))
