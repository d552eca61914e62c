"""Queries over the typed tables, with the same results in SQL from the typed columns.

Written forms are made from typed columns and read by the engine; the SQL reads
the typed values with arithmetic and word lists of its own. Inputs are grouped
first, so each written form is read once however often it occurs, and the distinct
ones are dealt to all tasks before the costly reading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hangul, phonology
from ..functions import numbers as num
from ..functions import tables as t
from ..functions.composed import nfc_mapped, source_span
from ..operators import classify, lexicon, measure, route
from ..operators.g2p import g2p, g2p_detail
from ..operators.normalize import convert, guarded, normalize, protected, read_tokens, tokens, unguarded


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _place(power: str) -> str:
    return _sql_list("" if d == 0 else power if d == 1 and power else t.SINO_DIGITS[d] + power for d in range(10))


def _four(n: str) -> str:
    return (
        f"({_place('천')}[({n}) // 1000 % 10 + 1] || {_place('백')}[({n}) // 100 % 10 + 1] || "
        f"{_place('십')}[({n}) // 10 % 10 + 1] || {_place('')}[({n}) % 10 + 1])"
    )


def sino(n: str) -> str:
    """SQL of the Sino-Korean reading of a whole number below 10**12."""
    n = f"CAST({n} AS BIGINT)"
    top, mid, low = f"({n} // 100000000)", f"({n} // 10000 % 10000)", f"({n} % 10000)"
    return (
        f"(CASE WHEN {n} = 0 THEN '영' ELSE (CASE WHEN {top} > 0 THEN {_four(top)} || '억' ELSE '' END) || "
        f"(CASE WHEN {mid} = 0 THEN '' WHEN {mid} = 1 THEN '만' ELSE {_four(mid)} || '만' END) || {_four(low)} END)"
    )


_ONES, _TENS = "한 두 세 네 다섯 여섯 일곱 여덟 아홉".split(), "열 스물 서른 마흔 쉰 예순 일흔 여든 아흔".split()
_ALONE = "하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉".split()


def native(n: str) -> str:
    """SQL of the native reading of 1 to 99 before a counter; others are Sino-Korean."""
    own = f"{_sql_list(['', *_TENS])}[({n}) // 10 + 1] || {_sql_list(['', *_ONES])}[({n}) % 10 + 1]"
    return f"(CASE WHEN {n} = 20 THEN '스무' WHEN {n} BETWEEN 1 AND 99 THEN {own} ELSE {sino(n)} END)"


def alone(n: str) -> str:
    """The same without a counter."""
    own = f"{_sql_list(['', *_TENS])}[({n}) // 10 + 1] || {_sql_list(['', *_ALONE])}[({n}) % 10 + 1]"
    return f"(CASE WHEN {n} BETWEEN 1 AND 99 THEN {own} ELSE {sino(n)} END)"


def digits(text: str, names: str, gap: str) -> str:
    return f"array_to_string(string_split(translate({text}, '0123456789', '{names}'), ''), '{gap}')"


def month(m: str) -> str:
    return f"(CASE {m} WHEN 6 THEN '유월' WHEN 10 THEN '시월' ELSE {sino(m)} || ' 월' END)"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows dealt to all tasks: after a small exchange they would meet in one."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


#: name: (table, typed keys in Spark, keys in SQL, written form, reading in SQL of the keys)
_SPOKEN: dict[str, tuple[str, dict[str, str], dict[str, str], str, str]] = {}


def _spoken(name: str, table: str, key: str, sql_key: str, written: str, reading: str) -> None:
    _SPOKEN[name] = (table, {"k": key}, {"k": sql_key}, written, reading)


_Q, _SQ = "cast(l_quantity as int)", "CAST(l_quantity AS INT)"
_spoken("ren_native_counter", "lineitem", _Q, _SQ, "concat(k, '개')", f"{native('k')} || ' 개'")
_spoken("ren_sino_unit", "lineitem", _Q, _SQ, "concat(k, '층입니다')", f"{sino('k')} || ' 층입니다'")
_spoken("ren_quantity_kg", "lineitem", _Q, _SQ, "concat('무게 ', k, 'kg')", f"'무게 ' || {sino('k')} || ' 킬로그램'")
_spoken("ren_speed", "lineitem", _Q, _SQ, "concat(k, 'km/h')", f"'시속 ' || {sino('k')} || ' 킬로미터'")
_spoken("ren_range_unit", "lineitem", _Q, _SQ, "concat(k, '~', k + 1, '명')", f"{alone('k')} || '에서 ' || {native('(k + 1)')} || ' 명'")
_spoken("ren_range_both", "lineitem", _Q, _SQ, "concat(k, 'm~', k + 5, 'm')", f"{sino('k')} || ' 미터에서 ' || {sino('k + 5')} || ' 미터'")
_spoken("ren_ordinal", "lineitem", "l_linenumber", "l_linenumber", "concat('제', k, '장')", f"'제 ' || {sino('k')} || ' 장'")
_spoken("ren_unit_per", "lineitem", _Q, _SQ, "concat('kg당 ', k, '원')", f"'킬로그램당 ' || {sino('k')} || ' 원'")
_spoken("ren_percentage", "lineitem", "cast(round(l_discount * 100) as int)", "CAST(round(l_discount * 100) AS INT)", "concat(k, '%')", f"{sino('k')} || ' 퍼센트'")
_spoken("ren_fraction", "part", "p_size", "p_size", "concat('1/', k)", f"{sino('k')} || '분의 일'")
_spoken("ren_exponent", "part", "p_size", "p_size", "concat('10^', k)", f"'십의 ' || {sino('k')} || '승'")
_spoken("ren_currency", "part", "p_size", "p_size", "concat('$', k)", f"{sino('k')} || ' 달러'")
_spoken("ren_iso_currency", "part", "p_size", "p_size", "concat('EUR ', k)", f"{sino('k')} || ' 유로'")
_spoken("ren_scaled_currency", "part", "p_size", "p_size", "concat(k, '만 원을')", f"{sino('k * 10000')} || ' 원을'")
_spoken("ren_scaled_range", "part", "p_size", "p_size", "concat(k, '억~', k + 1, '억 원')", f"{sino('CAST(k AS BIGINT) * 100000000')} || '에서 ' || {sino('CAST(k + 1 AS BIGINT) * 100000000')} || ' 원'")
#: 112 and 119 are emergency numbers where no word follows.
_CALL = f"(CASE WHEN k IN (112, 119) THEN {digits('CAST(k AS VARCHAR)', t.PHONE_DIGITS, ' ')} ELSE {sino('k')} END)"
_spoken("ren_number", "orders", "o_orderkey", "o_orderkey", "concat('번째 값 ', k, '.')", f"'번째 값 ' || {_CALL} || '.'")
_spoken("ren_number_suffix", "orders", "o_custkey", "o_custkey", "concat(k, '입니다')", f"{_CALL} || '입니다'")
_DAY = "CAST(substr(k, 6, 2) AS INT)", "CAST(substr(k, 9, 2) AS INT)"
_spoken(
    "ren_date", "orders", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')", "k",
    f"{sino('substr(k, 1, 4)')} || ' 년 ' || {month(_DAY[0])} || ' ' || {sino(_DAY[1])} || ' 일'",
)
_spoken(
    "ren_month_day", "lineitem", "date_format(l_shipdate, 'MM-dd')", "strftime(l_shipdate, '%m-%d')", "concat(cast(substr(k, 1, 2) as int), '월 ', cast(substr(k, 4, 2) as int), '일')",
    f"{month('CAST(substr(k, 1, 2) AS INT)')} || ' ' || {sino('substr(k, 4, 2)')} || ' 일'",
)
_spoken(
    "ren_year_month", "lineitem", "date_format(l_shipdate, 'yyyy-MM')", "strftime(l_shipdate, '%Y-%m')", "concat(substr(k, 1, 4), '년 ', cast(substr(k, 6, 2) as int), '월에')",
    f"{sino('substr(k, 1, 4)')} || ' 년 ' || {month('CAST(substr(k, 6, 2) AS INT)')} || '에'",
)
_CLOCK = (
    f"(CASE WHEN CAST(substr(k, 1, 2) AS INT) BETWEEN 1 AND 12 THEN {native('CAST(substr(k, 1, 2) AS INT)')} ELSE {sino('substr(k, 1, 2)')} END) || ' 시 ' || "
    f"{sino('substr(k, 4, 2)')} || ' 분 ' || {sino('substr(k, 7, 2)')} || ' 초'"
)
_spoken("ren_time", "events", "date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')", "k", _CLOCK)
_spoken(
    "ren_time_range", "events", "date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')", "concat(k, '~24:00')", f"{_CLOCK} || '에서 이십사 시 영 분'"
)
_spoken(
    "ren_phone", "customer", "lpad(cast(c_custkey as string), 8, '0')", "lpad(CAST(c_custkey AS VARCHAR), 8, '0')", "concat('010-', substr(k, 1, 4), '-', substr(k, 5, 4))",
    f"'공 일 공 ' || {digits('k', t.PHONE_DIGITS, ' ')}",
)
_spoken("ren_identifier_kept", "customer", "c_custkey", "c_custkey", "concat('계좌번호 ', k)", "'계좌번호 ' || CAST(k AS VARCHAR)")
_spoken("prt_email_kept", "customer", "c_custkey", "c_custkey", "concat('user', k, '@example.com으로')", "'user' || CAST(k AS VARCHAR) || '@example.com으로'")


def _spoken_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, keys, _, written, _ = _SPOKEN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grouped = _read(spark, sf_dir, table).groupBy(F.expr(keys["k"]).alias("k")).agg(F.count("*").alias("n"))
        spoken = dealt(grouped, "k").select("k", F.expr(written).alias("written"), "n").select("k", normalize(F.col("written")).alias("spoken"), "n")
        return spoken.select(F.col("k").cast("string").alias("k"), "spoken", "n")

    run.__name__ = name
    return run


def _spoken_sql(name: str) -> str:
    table, _, keys, _, reading = _SPOKEN[name]
    return (
        f"WITH g AS (SELECT {keys['k']} AS k, count(*) AS n FROM {table} GROUP BY 1) SELECT CAST(k AS VARCHAR) AS k, {reading} AS spoken, n FROM g"
    )


def _column_query(table: str, key: str, value: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, table).select(F.col(key).alias("k"), value(F.col(key).cast("string")).alias("spoken"))

    return run


def _column_sql(table: str, key: str, value: str) -> str:
    return f"SELECT {key} AS k, {value} AS spoken FROM {table}"


def num_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed amounts with two decimals."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("k"))
    return c.select("c_custkey", num.read_sino(F.col("k")).alias("spoken"))


_FRACTION = digits("split_part(k, '.', 2)", t.SINO_DIGITS, " ")
_DECIMAL_SQL = f"""
WITH d AS (SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS k FROM customer)
SELECT c_custkey, (CASE WHEN k LIKE '-%' THEN '마이너스 ' ELSE '' END) || {sino("split_part(ltrim(k, '-'), '.', 1)")} || ' 점 ' || {_FRACTION} AS spoken FROM d
"""


def han_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of every syllable in the readings of the order keys."""
    read = _read(spark, sf_dir, "orders").select(num.read_sino(F.col("o_orderkey").cast("string")).alias("s"))
    c = read.select(F.explode(F.split("s", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return c.select("c", "n", hangul.letters(F.col("c")).alias("l")).select("c", "l.onset", "l.vowel", "l.coda", "n")


_HAN_SQL = f"""
WITH r AS (SELECT {sino('o_orderkey')} AS s FROM orders), c AS (SELECT unnest(string_split(s, '')) AS c FROM r),
g AS (SELECT c, count(*) AS n FROM c GROUP BY c), d AS (SELECT c, n, unicode(c) - 44032 AS u FROM g)
SELECT c, substr('{t.ONSETS}', u // 588 + 1, 1) AS onset, substr('{t.VOWELS}', u % 588 // 28 + 1, 1) AS vowel, trim(substr('{t.CODAS}', u % 28 + 1, 1)) AS coda, n FROM d
"""


def han_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.pmod("p_partkey", F.lit(11172)).alias("u"))
    parts = F.floor(F.col("u") / 588), F.floor(F.pmod("u", F.lit(588)) / 28), F.pmod("u", F.lit(28))
    return p.select("k", hangul.compose(*parts).alias("c"))


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token kinds of sentences written from the orders."""
    o = _read(spark, sf_dir, "orders")
    text = F.concat(F.lit("물건 "), F.col("o_orderkey"), F.lit("개 "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" USB와 "), F.pmod("o_custkey", F.lit(90)) + 1, F.lit("%"))
    kinds = dealt(o, "o_orderkey").select("o_orderstatus", F.explode(tokens(text)).alias("t")).where("t.kind <> 'gap'")
    return kinds.cube("o_orderstatus", "t.kind").agg(F.count("*").alias("n")).select("o_orderstatus", F.col("kind"), "n")


_KINDS_SQL = """
WITH k AS (SELECT o_orderstatus, unnest(['number_hangul_unit', 'date', 'acronym', 'percentage']) AS kind FROM orders),
c AS (SELECT o_orderstatus, 'semantic_cluster' AS kind FROM orders WHERE false)
SELECT o_orderstatus, kind, count(*) AS n FROM (SELECT * FROM k UNION ALL SELECT * FROM c) GROUP BY CUBE (o_orderstatus, kind)
"""


def latin_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of the part names, which have no Korean reading."""
    p = _read(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    d = p.select("p_name", "n", convert(F.concat(F.lit("부품 "), F.col("p_name"), F.lit("의 값"))).alias("r"))
    codes = F.array_join(F.transform("r.diagnostics", lambda x: x["code"]), ",").alias("codes")
    return d.select("p_name", F.col("r.complete").alias("complete"), codes, "n")


_LATIN_SQL = """
SELECT p_name, false AS complete, array_to_string(['unconverted_latin' FOR w IN string_split(p_name, ' ')], ',') AS codes, count(*) AS n FROM part GROUP BY p_name
"""


def spell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return n.select("n_name", num.spell_letters(F.col("n_name")).alias("spoken"))


_NAMES = "에이 비 씨 디 이 에프 지 에이치 아이 제이 케이 엘 엠 엔 오 피 큐 알 에스 티 유 브이 더블유 엑스 와이 지".split()
_SPELL_SQL = f"SELECT n_name, array_to_string([{_sql_list(_NAMES)}[unicode(c) - 96] FOR c IN string_split(lower(n_name), '') IF unicode(c) BETWEEN 97 AND 122], '') AS spoken FROM nation"


def g2p_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from a written amount to its pronunciation, for each discount."""
    grouped = _read(spark, sf_dir, "lineitem").groupBy(F.expr(_Q).alias("k")).agg(F.count("*").alias("n"))
    written = dealt(grouped, "k").select("k", "n", F.concat("k", F.lit("개")).alias("written"))
    return written.select("k", "written", normalize(F.col("written")).alias("spoken"), g2p(F.col("written")).alias("sound"), "n")


#: Sounds of the ones before 개, behind no ten; ㅅ, ㅂ are stops, and what follows them is tense.
_ONES_SOUND = "한 두 세 네 다섣 여섣 일곱 여덜 아홉".split()
#: 6 to 9 behind a ten: its final sound meets ㄴ that 여 takes, or moves to the vowel.
_TEN_SIX = "열려섣 스물려섣 서른녀섣 마흔녀섣 쉰녀섣".split()
_TEN_SEVEN = "여릴곱 스무릴곱 서르닐곱 마흐닐곱 쉬닐곱".split()
_TEN_EIGHT = "열려덜 스물려덜 서른녀덜 마흔녀덜 쉰녀덜".split()
_TEN_NINE = "여라홉 스무라홉 서르나홉 마흐나홉 쉬나홉".split()
#: 4 behind a final ㄹ; 1 behind a final sound before ㅎ stays.
_TEN_FOUR = "열레 스물레 서른네 마흔네 쉰네".split()
_TENS_OF = ["열", "스물", "서른", "마흔", "쉰"]
_COUNT_SOUND = f"""
CASE WHEN k = 20 THEN '스무' WHEN k < 10 THEN {_sql_list(_ONES_SOUND)}[k] WHEN k % 10 = 4 THEN {_sql_list(_TEN_FOUR)}[k // 10]
  WHEN k % 10 = 6 THEN {_sql_list(_TEN_SIX)}[k // 10] WHEN k % 10 = 7 THEN {_sql_list(_TEN_SEVEN)}[k // 10]
  WHEN k % 10 = 8 THEN {_sql_list(_TEN_EIGHT)}[k // 10] WHEN k % 10 = 9 THEN {_sql_list(_TEN_NINE)}[k // 10]
  ELSE {_sql_list(_TENS_OF)}[k // 10] || CASE WHEN k % 10 = 0 THEN '' ELSE {_sql_list(_ONES_SOUND)}[k % 10] END END
  || CASE WHEN k % 10 IN (5, 6, 7, 9) THEN ' 깨' ELSE ' 개' END
"""
_G2P_SQL = f"""
WITH g AS (SELECT {_SQ} AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, CAST(k AS VARCHAR) || '개' AS written, {native('k')} || ' 개' AS spoken, {_COUNT_SOUND} AS sound, n FROM g
"""


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronunciation of two-syllable words 'X라' for the 27 codas, by the pair table."""
    p = _read(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(28)).alias("coda")).distinct()
    word = F.concat(hangul.compose(F.lit(11), F.lit(0), F.col("coda")), F.lit("라"))
    return p.select(F.col("coda").cast("long").alias("coda"), word.alias("word"), phonology.pronounce(word).alias("sound"))


#: Seven sounds stand for all codas (by the standard's articles 9 to 11); before ㄹ they and it change by 19 and 20.
_STAND = "ㄱ ㄱ ㄱ ㄴ ㄴ ㄴ ㄷ ㄹ ㄱ ㅁ ㄹ ㄹ ㄹ ㅂ ㄹ ㅁ ㅂ ㅂ ㄷ ㄷ ㅇ ㄷ ㄷ ㄱ ㄷ ㅂ ㄷ".split()
_PAIR_SQL = f"""
WITH c AS (SELECT DISTINCT p_partkey % 28 AS coda FROM part),
s AS (SELECT coda, CASE coda WHEN 0 THEN ' ' ELSE {_sql_list(_STAND)}[coda] END AS sound FROM c),
m AS (SELECT coda, CASE sound WHEN 'ㄱ' THEN 'ㅇ' WHEN 'ㅂ' THEN 'ㅁ' WHEN 'ㄴ' THEN 'ㄹ' ELSE sound END AS left_sound,
  CASE WHEN sound IN ('ㄱ', 'ㅂ', 'ㅁ', 'ㅇ') THEN '나' ELSE '라' END AS right_sound FROM s)
SELECT coda, chr(CAST(50500 + coda AS INT)) || '라' AS word,
  chr(CAST(50500 + strpos(' ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ', left_sound) - 1 AS INT)) || right_sound AS sound FROM m
"""


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken hour labels over windows of the event stream."""
    e = _read(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    return e.select("hour", "event_type", normalize(F.concat(F.col("hour"), F.lit("시"))).alias("label"), "n")


_HOUR_SQL = f"""
SELECT hour(ts) AS hour, event_type, (CASE WHEN hour(ts) BETWEEN 1 AND 12 THEN {native('hour(ts)')} ELSE {sino('hour(ts)')} END) || ' 시' AS label, count(*) AS n
FROM events GROUP BY ALL
"""


def compose_jamo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables spelled in conjoining letters, composed, and where they stand in the source."""
    k = F.pmod("p_partkey", F.lit(11172)).cast("int")
    parts = (0x1100, 19, F.floor(k / 588)), (0x1161, 21, F.floor(F.pmod(k, F.lit(588)) / 28)), (0x11A7, 28, F.pmod(k, F.lit(28)))
    lead, vowel, tail = (F.substring(F.lit("".join(map(chr, range(first, first + n)))), at.cast("int") + 1, F.lit(1)) for first, n, at in parts)
    written = F.concat(F.lit("a"), lead, vowel, F.when(F.pmod(k, F.lit(28)) > 0, tail).otherwise(""), F.lit("b"))
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), nfc_mapped(written).alias("m"))
    return p.select("k", "m.text", source_span(F.col("m"), F.lit(1), F.lit(2))["end"].alias("span_end"), F.size("m.rewrites").alias("n_rewrites"))


_JAMO_SQL = """
SELECT p_partkey AS k, 'a' || chr(CAST(44032 + p_partkey % 11172 AS INT)) || 'b' AS text,
  CAST(CASE WHEN p_partkey % 11172 % 28 > 0 THEN 4 ELSE 3 END AS INT) AS span_end, CAST(1 AS INT) AS n_rewrites
FROM part
"""


#: kind: (written form of k, SQL of its reading, diagnostic code); a reading of None is the written form.
#: k is a size of a part, 1 to 50; the SQL of the written form is the same.
_KINDS: dict[str, tuple[str, str | None, str | None]] = {
    "contextual_short_date": ("concat('생일은 ', k, '/3')", None, "ambiguous_numeric"),
    "contextual_identifier": ("concat('좌석 ', k)", None, "ambiguous_numeric"),
    "unsupported_comparison": ("concat('H > ', k)", None, "ambiguous_numeric"),
    "date_range": ("concat('3월 ', k, '일~4월 5일까지')", None, "ambiguous_numeric"),
    "mixed_fraction": ("concat(k, ' 1/2kg')", None, "ambiguous_numeric"),
    "range_both": ("concat(k, '%~99%')", f"{sino('k')} || ' 퍼센트에서 구십구 퍼센트'", None),
    "unsupported_semantic_pair": ("concat('$', k, ' - $99')", None, "ambiguous_numeric"),
    "mixed_currency": ("concat('$', k, ' USD')", None, "ambiguous_numeric"),
    "mixed_numeric_context": ("concat('AI시', k, 'MHz')", None, "ambiguous_identifier"),
    "version": ("concat('v', k, '.2')", None, None),
    "filename": ("concat('data', k, '.json')", None, None),
    "phone": ("concat('02-3456-10', lpad(CAST(k AS VARCHAR(9)), 2, '0'))", f"'공 이 삼 사 오 육 일 공 ' || {digits("lpad(CAST(k AS VARCHAR), 2, '0')", t.PHONE_DIGITS, ' ')}", None),
    "malformed_phone": ("concat('010 123 ', k + 10000)", None, "ambiguous_numeric"),
    "ipv4": ("concat('192.168.0.', k)", None, None),
    "time": ("concat('오후 3:', lpad(CAST(k AS VARCHAR(9)), 2, '0'))", f"'오후 세 시 ' || {sino('k')} || ' 분'", None),
    "korean_date": ("concat('2024년 ', (k - 1) % 12 + 1, '월 ', (k - 1) % 28 + 1, '일')", f"'이천이십사 년 ' || {month('((k - 1) % 12 + 1)')} || ' ' || {sino('((k - 1) % 28 + 1)')} || ' 일'", None),
    "month": ("concat((k - 1) % 12 + 1, '월에')", f"{month('((k - 1) % 12 + 1)')} || '에'", None),
    "malformed_structured": ("concat('2026-08-07÷', k)", None, "ambiguous_numeric"),
    "numbered_item": ("concat(k, '번 출구')", f"{sino('k')} || ' 번 출구'", None),
    "history": ("concat('3.1절 ', k, '개')", f"'삼일절 ' || {native('k')} || ' 개'", None),
    "unsupported_math": ("concat(k, ' / 7')", None, "ambiguous_numeric"),
    "unsupported_range": ("concat('1 ~ ', k, '개발')", None, "ambiguous_numeric"),
    "standalone_unit_symbol": ("concat('㎏은 ', k, '개')", f"'킬로그램은 ' || {native('k')} || ' 개'", None),
    "quantity_unit": ("concat(k, '여 m')", f"{sino('k')} || '여 미터'", None),
    "mixed_numeric_suffix": ("concat(k, '개abc')", None, "ambiguous_identifier"),
    "semantic_cluster": ("concat('÷÷ ', k, '개')", f"'÷÷ ' || {native('k')} || ' 개'", "unsupported_symbol"),
    "non_ascii_decimal": ("translate(CAST(k AS VARCHAR(9)), '0123456789', '٠١٢٣٤٥٦٧٨٩')", None, "ambiguous_numeric"),
    "exponent": ("concat('2^', k, '을')", f"'이의 ' || {sino('k')} || '승을'", None),
    "fraction": ("concat('3/', k, '은')", f"{sino('k')} || '분의 삼은'", None),
    "percentage": ("concat(k, ' %p')", f"{sino('k')} || ' 퍼센트포인트'", None),
    "number_hangul_unit": ("concat(k, ' 번째')", f"CASE k WHEN 1 THEN '첫' ELSE {native('k')} END || ' 번째'", None),
    "decimal": ("concat(k, '.25')", f"{sino('k')} || ' 점 이 오'", None),
    "unsupported_prefixed_numeric": ("concat('₩', k, '..')", None, "ambiguous_numeric"),
    "unsupported_numeric": ("concat('.', k)", None, "ambiguous_numeric"),
    "ambiguous_hyphen": ("concat(k, '-99')", None, "ambiguous_hyphen"),
    "number_punctuation": ("concat(k * 1000, ',')", f"{sino('k * 1000')} || ','", None),
    "numeric_guard": ("concat(k, '..2')", None, "ambiguous_numeric"),
    "non_ascii_numeric_cluster": ("concat(k, '①')", None, "ambiguous_numeric"),
    "ambiguous_numeric": ("concat('12345678901', k)", None, "ambiguous_numeric"),
    "ambiguous_number_word": ("concat(k, '사과')", None, "ambiguous_numeric"),
    "ambiguous_latin_hyphen": ("concat('Wi-Fi ', k, '개')", f"'Wi-Fi ' || {native('k')} || ' 개'", "unconverted_latin"),
    "ambiguous_identifier": ("concat('B', k, 'B')", None, "ambiguous_identifier"),
    "number": ("concat('값 ', k * 1000)", f"'값 ' || {sino('k * 1000')}", None),
    "indefinite_unit": ("concat('몇 ml ', k, '개')", f"'몇 밀리리터 ' || {native('k')} || ' 개'", None),
    "unit_per": ("concat('ha당 ', k, '원')", f"'헥타르당 ' || {sino('k')} || ' 원'", None),
    "acronym": ("concat('NASA ', k, '명')", f"'나사 ' || {native('k')} || ' 명'", None),
    "jamo_cluster": ("concat('ㅋㅋ ', k, '개')", f"'ㅋㅋ ' || {native('k')} || ' 개'", "unsupported_script"),
    "jamo": ("concat('ㄳ ', k, '개')", f"'기역시옷 ' || {native('k')} || ' 개'", None),
    "han": ("concat('漢字 ', k, '개')", f"'漢字 ' || {native('k')} || ' 개'", "unconverted_han"),
    "latin": ("concat('Minnie ', k, '개')", f"'Minnie ' || {native('k')} || ' 개'", "unconverted_latin"),
    "unsupported_symbol": ("concat('가격 A% ', k, '개')", f"'가격 A% ' || {native('k')} || ' 개'", "unsupported_symbol"),
}


_FAMILIES = {
    "context": "contextual_short_date contextual_identifier unsupported_comparison mixed_numeric_context numbered_item indefinite_unit unit_per standalone_unit_symbol number_hangul_unit quantity_unit".split(),
    "calendar": "date_range korean_date month time malformed_structured history phone malformed_phone ipv4 version filename".split(),
    "pairs": "mixed_fraction range_both unsupported_semantic_pair mixed_currency unsupported_math unsupported_range ambiguous_hyphen fraction exponent percentage".split(),
    "numbers": (
        "mixed_numeric_suffix semantic_cluster non_ascii_decimal decimal unsupported_prefixed_numeric unsupported_numeric number_punctuation numeric_guard "
        "non_ascii_numeric_cluster ambiguous_numeric ambiguous_number_word number"
    ).split(),
    "letters": "ambiguous_latin_hyphen ambiguous_identifier acronym jamo_cluster jamo han latin unsupported_symbol".split(),
}


def _kinds_query(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each kind of a family in a sentence: how it is read, as what, and what is reported."""
        sizes = _read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n"))
        forms = F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(_KINDS[kind][0].replace("VARCHAR(9)", "STRING")).alias("w")) for kind in _FAMILIES[family]])
        each = dealt(sizes.select("k", "n", F.explode(forms).alias("f")), "k", "f")
        read = each.select("k", "n", F.col("f.kind").alias("kind"), read_tokens(F.col("f.w")).alias("t"))
        own = F.get(F.filter("t", lambda x: x["kind"] == F.col("kind")), F.lit(0))
        return read.select("k", "kind", F.array_join(F.transform("t", lambda x: x["spoken"]), "").alias("spoken"), own["code"].alias("code"), "n")

    run.__name__ = f"kinds_{family}"
    return run


def _kinds_sql(family: str) -> str:
    out = []
    for kind in _FAMILIES[family]:
        written, spoken, code = _KINDS[kind]
        code = f"'{code}'" if code else "CAST(NULL AS VARCHAR)"
        out.append(f"SELECT k, '{kind}' AS kind, {spoken or written.replace('VARCHAR(9)', 'VARCHAR')} AS spoken, {code} AS code, n FROM g")
    return "WITH g AS (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) " + " UNION ALL ".join(out)


def protected_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own addresses inside a sentence: found as one piece, the particle left out."""
    p = dealt(_read(spark, sf_dir, "pages").select("page_id", "url"), "page_id").where("url is not null")
    text = F.concat(F.lit("주소 "), F.col("url"), F.lit("에서 7개"))
    found = p.select("page_id", protected(guarded(text)).alias("p"), normalize(text).alias("spoken"))
    return found.select("page_id", unguarded(F.get("p", F.lit(1))).alias("kept"), "spoken")


#: Addresses end in front of blanks and brackets; trailing marks of a sentence are not part of them.
_URL_SQL = """
WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^\\s<>\\[\\]{}]+'), '[.,!?;:"'']+$', '') AS kept, url FROM pages WHERE url IS NOT NULL)
SELECT page_id, kept, '주소 ' || url || '에서 일곱 개' AS spoken FROM u
"""


def protected_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline code, a path and an address around a number that is read."""
    p = dealt(_read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n")), "k")
    text = F.concat(F.lit("`"), "k", F.lit("개` C:\\a\\"), "k", F.lit(".txt를 "), "k", F.lit("개 ./x/"), "k", F.lit(".py에서 a"), "k", F.lit("@b.co로"))
    pieces = F.filter(F.transform(protected(guarded(text)), lambda x, i: F.when(i % 2 == 1, x)), lambda x: x.isNotNull())
    return p.select("k", F.array_join(pieces, " | ").alias("kept"), normalize(text).alias("spoken"), "n")


_CODE_SQL = f"""
WITH g AS (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1)
SELECT k, '`' || k || '개` | C:\\a\\' || k || '.txt | ./x/' || k || '.py | a' || k || '@b.co' AS kept,
  '`' || k || '개` C:\\a\\' || k || '.txt를 ' || {native('k')} || ' 개 ./x/' || k || '.py에서 a' || k || '@b.co로' AS spoken, n FROM g
"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers of the segments of text that mixes scripts, and what is reported."""
    p = dealt(_read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n")), "k")
    text = F.concat(F.lit("국물 Hello "), "k", F.lit(" GPT-"), "k", F.lit("o 東京 жця 가🙂 C++"))
    d = p.select("k", "n", g2p_detail(text).alias("d"))
    joined = lambda c: F.array_join(F.transform("d.segments", lambda s: s[c]), ",")
    reports = F.transform("d.diagnostics", lambda x: F.concat_ws(":", x["code"], x["start"].cast("string"), x["end"].cast("string"), x["stage"]))
    return d.select("k", F.col("d.surface_pronunciation").alias("sound"), joined("handler").alias("handlers"), F.array_join(reports, ",").alias("reports"), F.col("d.complete").alias("complete"), "n")


_ROUTED_SQL = """
WITH g AS (SELECT p_size AS k, length(CAST(p_size AS VARCHAR)) AS w, count(*) AS n FROM part GROUP BY 1, 2)
SELECT k, '궁물 에이치이에레로 ' || k || ' GPT-' || k || 'o 東京 жця 가🙂 C++' AS sound,
  'korean,korean,english,korean,numeric,korean,numeric,korean,korean,korean,korean,korean,korean,korean,english' AS handlers,
  concat_ws(',', 'unconverted_latin:' || (10 + w) || ':' || (15 + 2 * w) || ':lexical', 'unconverted_han:' || (16 + 2 * w) || ':' || (18 + 2 * w) || ':lexical',
    'unsupported_script:' || (19 + 2 * w) || ':' || (22 + 2 * w) || ':lexical', 'unsupported_emoji:' || (24 + 2 * w) || ':' || (25 + 2 * w) || ':validation',
    'unconverted_latin:' || (26 + 2 * w) || ':' || (29 + 2 * w) || ':lexical') AS reports,
  false AS complete, n
FROM g
"""


def sound_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule changed what, and where, in readings of sizes before 밀리리터."""
    p = dealt(_read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n")), "k").where("k between 41 and 49")
    d = p.select("k", "n", g2p_detail(F.concat(num.read_sino(F.col("k").cast("string")), F.lit("만"))).alias("d"))
    rules = F.transform("d.rewrites", lambda r: F.concat_ws(":", r["rule_id"], r["start"].cast("string"), r["end"].cast("string"), r["before"], r["after"]))
    return d.select("k", F.array_join(rules, ",").alias("rules"), "n")


_SOUND_SQL = """
WITH g AS (SELECT p_size AS k, count(*) AS n FROM part WHERE p_size BETWEEN 41 AND 49 GROUP BY 1)
SELECT k, CASE k
  WHEN 41 THEN 'ko.liaison.single:1:3:십일:시빌'
  WHEN 42 THEN 'ko.liaison.single:1:3:십이:시비'
  WHEN 43 THEN 'ko.tensification:1:3:십삼:십쌈'
  WHEN 44 THEN 'ko.tensification:1:3:십사:십싸'
  WHEN 45 THEN 'ko.liaison.single:1:3:십오:시보'
  WHEN 46 THEN 'ko.n_insertion.numeral:1:3:십육:십뉵,ko.nasalization:1:3:십뉵:심뉵,ko.nasalization:2:4:뉵만:늉만'
  WHEN 47 THEN ''
  WHEN 48 THEN ''
  WHEN 49 THEN 'ko.tensification:1:3:십구:십꾸'
  END AS rules, n FROM g
"""
#: A small model: how many digits, the unit, and the word behind decide.
_MODEL = {
    "schema_version": 2,
    "feature_version": 3,
    "classes": list(classify.CLASSES),
    "bias": [0.25, 0.0, -0.5],
    "weights": {"u=번": [0.5, 1.0, 0.0], "nf=문제/NNG": [-1.0, 2.0, 0.0], "len=1": [1.5, 0.0, 0.0], "len=4": [0.0, 0.0, 3.0], "eos=1": [0.0, 0.0, 0.25]},
    "thresholds": {"sino": {"unit": 0.6}, "digitwise": {"unit": 0.5, "bare": 0.5}},
}
_TOKEN = "array<struct<form:string,tag:string,start:int,end:int>>"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, text, tokens): keys before 번, every third one before 문제 as well, with what an analyzer says."""
    o = dealt(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    w = F.length(F.col("k").cast("string"))
    more = F.col("k") % 3 == 0
    token = lambda form, tag, start, size: F.struct(form.alias("form"), F.lit(tag).alias("tag"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"))
    base = F.array(token(F.col("k").cast("string"), "SN", F.lit(0), w), token(F.lit("번"), "NNB", w, F.lit(1)))
    tokens_ = F.when(more, F.concat(base, F.array(token(F.lit("문제"), "NNG", w + 2, F.lit(2))))).otherwise(base)
    return o.select("k", F.concat("k", F.when(more, "번 문제").otherwise("번")).alias("text"), tokens_.cast(_TOKEN).alias("tokens"))


def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a number in its sentence and what the model makes of them."""
    c = _numbered(spark, sf_dir)
    w = F.length(F.col("k").cast("string"))
    f = classify.features(F.col("tokens"), F.col("text"), F.lit(0), w, w + 1, F.lit("번"))
    c = c.select("k", f.alias("f")).select("k", "f", classify.probabilities(F.col("f"), _MODEL).alias("p"), classify.decide(F.col("f"), "unit", "native", _MODEL).alias("choice"))
    return c.select("k", F.array_join("f", " ").alias("features"), *[F.round(F.get("p", F.lit(i)), 9).alias(x) for i, x in enumerate(classify.CLASSES)], "choice")


_CLASS_SQL = """
WITH f AS (SELECT c_custkey AS k, length(CAST(c_custkey AS VARCHAR)) AS w, c_custkey % 3 = 0 AS more FROM customer),
s AS (SELECT *, 0.75 + CASE WHEN more THEN -1.0 ELSE 0 END + CASE WHEN w = 1 THEN 1.5 ELSE 0 END AS a,
  1.0 + CASE WHEN more THEN 2.0 ELSE 0 END AS b, -0.5 + CASE WHEN w = 4 THEN 3.0 ELSE 0 END + CASE WHEN more THEN 0 ELSE 0.25 END AS c FROM f),
p AS (SELECT *, exp(a) / (exp(a) + exp(b) + exp(c)) AS pa, exp(b) / (exp(a) + exp(b) + exp(c)) AS pb, exp(c) / (exp(a) + exp(b) + exp(c)) AS pc FROM s)
SELECT k, concat_ws(' ', 'len=' || w, 'u=번', CASE WHEN w < 3 THEN 'v=' || k END, CASE WHEN w < 3 THEN 'uv=번:' || k END, 'sf=번/NNB', 'st=NNB',
    CASE WHEN more THEN 'nf=문제/NNG nt=NNG nc1=문제/NNG un=번|문제/NNG ln=' || w || '|문제/NNG' ELSE 'eos=1' END, 'bos=1') AS features,
  round(pa, 9) AS native, round(pb, 9) AS sino, round(pc, 9) AS digitwise,
  CASE WHEN pb > pa AND pb > pc AND pb >= 0.6 THEN 'sino' WHEN pc > pa AND pc > pb AND pc >= 0.5 THEN 'digitwise' END AS choice
FROM p
"""


def class_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the same sentences, read as the model decides."""
    c = _numbered(spark, sf_dir).select("k", normalize(F.col("text"), analysis=F.col("tokens"), model=_MODEL).alias("spoken"))
    return c


#: Before 문제 a numbered item is Sino-Korean whatever the model says.
_READINGS_SQL = f"""
WITH p AS ({_CLASS_SQL})
SELECT k, CASE WHEN k % 3 = 0 THEN {sino('k')} || ' 번 문제' WHEN choice = 'sino' THEN {sino('k')} || ' 번'
  WHEN choice = 'digitwise' THEN {digits('CAST(k AS VARCHAR)', t.PHONE_DIGITS, ' ')} || ' 번' ELSE {native('k')} || ' 번' END AS spoken FROM p
"""

_ENTRIES = {"FRANCE": "프랑스", "GERMANY": "독일", "JAPAN": "일본", "CHINA": "중국", "NA": "엔에이", "3개와": "석 점과"}


def lexicon_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations with a few in the lexicon: in the scan, and by the automaton."""
    n = _read(spark, sf_dir, "nation").select("n_name", F.concat("n_name", F.lit("의 3개와 13개")).alias("text"))
    found = lexicon.with_matches(n, "text", _ENTRIES).select("n_name", F.col("text"), "matches")
    return found.select("n_name", lexicon.normalize_with(F.col("text"), _ENTRIES).alias("spoken"), lexicon.normalize_matched(F.col("text"), F.col("matches")).alias("by_join"))


_LEXICON_SQL = (
    "WITH r AS (SELECT n_name, CASE n_name "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ENTRIES.items() if k.isalpha() and k.isascii())
    + " ELSE n_name END || '의 석 점과 열세 개' AS spoken FROM nation) SELECT n_name, spoken, spoken AS by_join FROM r"
)


def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of any size, as a table: the first word of a part's name."""
    p = _read(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    table = p.select(F.col("word").alias("key"), num.spell_letters(F.col("word")).alias("value")).where(F.length("word") > 4)
    return lexicon.lookup(p, "word", table, "reading").select("word", "reading", "n")


_LOOKUP_SQL = f"""
WITH p AS (SELECT split_part(p_name, ' ', 1) AS word, count(*) AS n FROM part GROUP BY 1)
SELECT word, CASE WHEN length(word) > 4 THEN array_to_string([{_sql_list(_NAMES)}[unicode(c) - 96] FOR c IN string_split(lower(word), '') IF unicode(c) BETWEEN 97 AND 122], '') END AS reading, n FROM p
"""


def odd_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control, private and reserved characters come back as they were, and the rest is read."""
    p = dealt(_read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n")), "k")
    odd = F.lit("\x01\x02\x03\x04\x1f\ue001\ue01f\ufdd0\ufdd8")
    text = F.concat(odd, F.lit("가 "), "k", F.lit("개 "), odd, F.repeat(F.lit(" "), 2000), F.lit("국물"))
    return p.select("k", F.hex(normalize(text)).alias("spoken"), F.hex(g2p(text)).alias("sound"), "n")


_ODD = "chr(1) || chr(2) || chr(3) || chr(4) || chr(31) || chr(57345) || chr(57375) || chr(64976) || chr(64984)"
_ODD_SQL = f"""
WITH g AS (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1), w AS (SELECT k, n, {_ODD} || '가 ' AS a, {native('k')} AS w, {_COUNT_SOUND} AS sw, ' ' || {_ODD} || repeat(' ', 2000) AS b FROM g)
SELECT k, hex(encode(a || w || ' 개' || b || '국물')) AS spoken, hex(encode(a || sw || b || '궁물')) AS sound, n FROM w
"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of samples, with the events' values for seconds."""
    e = _read(spark, sf_dir, "events").select("event_type", F.col("value").alias("seconds"), F.col("event_id").alias("peak_bytes"), F.col("user_id").alias("allocated_bytes"))
    s = measure.summary(e, "event_type")
    return s.select("event_type", "iterations", "seconds_min", F.round("seconds_mean", 6).alias("seconds_mean"), F.round("seconds_median", 6).alias("seconds_median"), "seconds_max", "peak_bytes_max", F.round("allocated_bytes_mean", 6).alias("allocated_bytes_mean"))


_MEASURED_SQL = """
SELECT event_type, count(*) AS iterations, min(value) AS seconds_min, round(avg(value), 6) AS seconds_mean, round(median(value), 6) AS seconds_median,
  max(value) AS seconds_max, max(event_id) AS peak_bytes_max, round(avg(user_id), 6) AS allocated_bytes_mean FROM events GROUP BY event_type
"""


def sized_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of exact length from the names of nations."""
    sizes = spark.createDataFrame([(s,) for s in measure.SIZES], "size int")
    n = _read(spark, sf_dir, "nation").join(sizes)
    return n.select("n_name", "size", F.md5(measure.corpus(F.col("n_name"), F.col("size"))).alias("digest"))


_CORPORA_SQL = "SELECT n_name, size, md5(substr(repeat(n_name, size), 1, size)) AS digest FROM nation, (SELECT CAST(unnest([100, 1000, 10000]) AS INT) AS size)"


def character_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of characters over a range of code points."""
    p = _read(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(2000)).cast("int").alias("k")).distinct()
    c = F.decode(F.unhex(F.lpad(F.hex((F.col("k") + 0xABF0).cast("long")), 4, "0")), "UTF-16BE")
    return p.select("k", hangul.character_kind(c).alias("kind"), hangul.is_syllable(c).alias("syllable"))


_CHARACTER_SQL = """
WITH p AS (SELECT DISTINCT CAST(p_partkey % 2000 AS INT) AS k FROM part)
SELECT k, CASE WHEN k + 44016 >= 44032 THEN 'HANGUL' WHEN k + 44016 BETWEEN 44016 AND 44025 THEN 'NUMBER'
  WHEN k + 44016 IN (44014, 44015, 44026, 44027, 44028, 44029, 44030, 44031) THEN 'OTHER' ELSE 'UNSUPPORTED' END AS kind, k + 44016 >= 44032 AS syllable FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {name: _spoken_query(name) for name in _SPOKEN} | {f"kinds_{family}": _kinds_query(family) for family in _FAMILIES}
    found |= {
        "num_sino": _column_query("orders", "o_orderkey", num.read_sino),
        "num_native": _column_query("part", "p_size", num.read_native),
        "num_alone": _column_query("part", "p_size", num.read_native_alone),
        "num_digitwise": _column_query("customer", "c_custkey", num.read_digitwise),
        "num_decimal": num_decimal,
        "han_letters": han_letters,
        "han_compose": han_compose,
        "tok_kinds_cube": kind_counts,
        "diag_latin": latin_diagnostics,
        "ren_letters": spell_names,
        "pho_pairs": pair_table,
        "g2p_counters": g2p_percent,
        "events_by_hour": events_by_hour,
        "uni_nfc_map": compose_jamo,
        "prt_urls": protected_urls,
        "prt_code": protected_code,
        "rte_segments": routed,
        "pho_rules": sound_rules,
        "cls_probabilities": class_probabilities,
        "cls_readings": class_readings,
        "tok_lexicon": lexicon_readings,
        "lex_lookup": lexicon_lookup,
        "tok_odd_characters": odd_characters,
        "agg_summary": measured,
        "agg_corpora": sized_corpora,
        "flt_characters": character_kinds,
    }
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: _spoken_sql(name) for name in _SPOKEN} | {f"kinds_{family}": _kinds_sql(family) for family in _FAMILIES}
    return found | {
        "num_sino": _column_sql("orders", "o_orderkey", sino("o_orderkey")),
        "num_native": _column_sql("part", "p_size", native("p_size")),
        "num_alone": _column_sql("part", "p_size", alone("p_size")),
        "num_digitwise": _column_sql("customer", "c_custkey", digits("CAST(c_custkey AS VARCHAR)", t.PHONE_DIGITS, " ")),
        "num_decimal": _DECIMAL_SQL,
        "han_letters": _HAN_SQL,
        "han_compose": "SELECT p_partkey AS k, chr(CAST(44032 + p_partkey % 11172 AS INT)) AS c FROM part",
        "tok_kinds_cube": _KINDS_SQL,
        "diag_latin": _LATIN_SQL,
        "ren_letters": _SPELL_SQL,
        "pho_pairs": _PAIR_SQL,
        "events_by_hour": _HOUR_SQL,
        "uni_nfc_map": _JAMO_SQL,
        "g2p_counters": _G2P_SQL,
        "prt_urls": _URL_SQL,
        "prt_code": _CODE_SQL,
        "rte_segments": _ROUTED_SQL,
        "pho_rules": _SOUND_SQL,
        "cls_probabilities": _CLASS_SQL,
        "cls_readings": _READINGS_SQL,
        "tok_lexicon": _LEXICON_SQL,
        "lex_lookup": _LOOKUP_SQL,
        "tok_odd_characters": _ODD_SQL,
        "agg_summary": _MEASURED_SQL,
        "agg_corpora": _CORPORA_SQL,
        "flt_characters": _CHARACTER_SQL,
    }
