import json

import pytest
from pyspark.sql import functions as F

from sorimill.functions import phonology
from sorimill.operators import classify
from sorimill.operators.g2p import g2p, g2p_detail
from sorimill.operators.normalize import convert, normalize

SOUNDS = """
꽃 꼳
옷이 오시
넋이 넉씨
국물 궁물
신라 실라
국밥 국빱
좋다 조타
놓는 논는
많아 마나
굳이 구지
굳히다 구치다
십육 심뉵
스물여섯 스물려섣
맑게 맑게
밟다 밟다
밟아 발바
넓죽하다 넓죽하다
넓둥글다 넓둥글다
짓밟다 짓밟다
닭밭 닥빧
가져 가저
희망 히망
"""


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_pronunciation(spark):
    rows = [x.split() for x in SOUNDS.strip().splitlines()]
    assert run(spark, [a for a, _ in rows], phonology.pronounce) == [b for _, b in rows]
    assert run(spark, ["옷 한 벌", "한국 사람", "값이 없다", "각 3 년", None, ""], phonology.pronounce) == ["오 탄 벌", "한국 싸람", "갑씨 업따", "각 3 년", None, ""]


def test_table_covers_every_pair():
    assert len(phonology.table()) == 28 * 20 * 3 * 2 * 2
    assert phonology.pair("ㅌ", "ㅇ", "ㅣ", False)[2] == ["ko.palatalization"]
    assert phonology.pair("ㄱ", "ㅁ", "ㅏ", True) == ("ㅇ", "ㅁ", ["ko.nasalization"])


#: text, tokens as form/tag/start, pronunciation with them.
ANALYZED = [
    ("우리의", "우리/NP/0 의/JKG/2", "우리에"),
    ("우리 의", "우리/NP/0 의/JKG/3", "우리 의"),
    ("의의", "의의/NNG/0", "의의"),
    ("맑게", "맑/VA/0 게/EC/1", "말께"),
    ("닭과", "닭/NNG/0 과/JC/1", "닥꽈"),
    ("신고", "신/VV/0 고/EC/1", "신꼬"),
    ("신고", "신고/NNG/0", "신고"),
    ("앉고", "앉/VV/0 고/EC/1", "안꼬"),
    ("닮지", "닮/VV/0 지/EC/1", "담찌"),
    ("넓게", "넓/VA/0 게/EC/1", "널께"),
    ("핥다", "핥/VV/0 다/EF/1", "할따"),
    ("할  것을", "할/VX+ETM/0 것/NNB/3 을/JKO/4", "할  꺼슬"),
    ("쌀 밥", "쌀/NNG/0 밥/NNG/2", "쌀 밥"),
    ("a1 맑게,", "맑/VA/3 게/EC/4", "a1 말께,"),
    ("밟다", "밟/VV/0 다/EF/1", "밟다"),
    ("맑게", "맑게/VA/0 게/EC/1", "맑게"),  # tokens overlap
    ("맑게", "말/VA/0 게/EC/1", "맑게"),  # not the text's
    ("맑게", None, "맑게"),
    ("국물", "", "궁물"),
    ("", "", ""),
    (None, "", None),
]


def test_analyzed(spark):
    def parse(x):
        return None if x is None else [(f, tag, int(at), int(at) + len(f)) for f, tag, at in (y.split("/") for y in x.split())]

    rows = spark.createDataFrame([(i, a, parse(b)) for i, (a, b, _) in enumerate(ANALYZED)], "i int, x string, k array<struct<form:string,tag:string,start:int,end:int>>")
    got = {r.i: r.y for r in rows.select("i", phonology.pronounce(F.col("x"), F.col("k")).alias("y")).collect()}
    assert [got[i] for i in range(len(ANALYZED))] == [c for _, _, c in ANALYZED]


def test_g2p(spark):
    texts = ["16%", "26개", "L는", "010-1234-5678", "https://a.b/국물 국물"]
    got = run(spark, texts, g2p)
    assert got == ["심뉵 퍼센트", "스물려섣 깨", "엘른", "공 일 공 일 이 삼 사 오 육 칠 팔", "https://a.b/국물 궁물"]
    assert run(spark, ["3개 국물"], lambda c: g2p(c, normalize=False)) == ["3개 궁물"]
    assert run(spark, ["NAVER 뉴스"], lambda c: g2p(c, lexicon={"NAVER": "네이버"})) == ["네이버 뉴스"]
    with pytest.raises(ValueError):
        g2p(F.col("x"), normalize=0)
    with pytest.raises(Exception, match="longer than 3"):
        run(spark, ["가나다라"], lambda c: g2p(c, normalize=False, max_length=3))


#: Text, its pronunciation, handlers of its segments, reports as code:start:end.
ROUTED = [
    ("Hello", "에이치이에레로", "english", ""),
    ("東京", "東京", "korean", "unconverted_han:0:2"),
    ("GPT-4o", "GPT-4o", "numeric", "unconverted_latin:0:6"),
    ("테스트3", "테스트3", "numeric", ""),
    ("3A", "3A", "numeric", "unconverted_latin:0:2"),
    ("жця世界", "жця世界", "korean korean", "unsupported_script:0:3 unconverted_han:3:5"),
    ("٤٢", "٤٢", "numeric", ""),
    ("²Ⅳ", "²Ⅳ", "numeric", ""),
    ("四五", "四五", "numeric", ""),
    ("四季", "四季", "korean", "unconverted_han:0:2"),
    ("가🙂나", "가🙂나", "korean korean korean", "unsupported_emoji:1:2"),
    ("https://жця.example.com", "https://жця.example.com", "protected", "unsupported_script:8:11"),
    ("L는", "엘른", "english korean", ""),
    ("\u1100\u1161꽃", "가꼳", "korean", ""),
    ("Wi-Fi C++", "Wi-Fi C++", "english korean english", "unconverted_latin:0:5 unconverted_latin:6:9"),
    ("a\u200bb", "에이\u200b비", "english korean english", "unsupported_character:1:2"),
    ("할\n것", "할\n걷", "korean korean korean", ""),
    ("맑게", "맑게", "korean", "analyzer_unavailable:0:2 morphology_rule_skipped:0:2"),
    ("밟다", "밟다", "korean", "morphology_rule_skipped:0:2"),
    ("우리의", "우리의", "korean", "analyzer_unavailable:2:3 morphology_rule_skipped:2:3"),
    ("", "", "", ""),
]


def test_detail(spark):
    got = run(spark, [r[0] for r in ROUTED] + [None], g2p_detail)
    assert got[-1] is None
    for (text, sound, handlers, reports), r in zip(ROUTED, got):
        assert (r.surface_pronunciation, " ".join(s.handler for s in r.segments)) == (sound, handlers), text
        assert " ".join(f"{d.code}:{d.start}:{d.end}" for d in r.diagnostics) == reports, text
        assert r.complete == (not reports) and r.source == text
        assert "".join(s.text for s in r.segments) == r.normalized_text


#: Text and the rules that change it, in order.
CHANGES = [
    ("닭밭", "ko.coda.11 ko.coda.9 ko.tensification"),
    ("십육", "ko.n_insertion.numeral ko.nasalization"),
    ("가져 희", "ko.vowel.jyeo ko.vowel.consonant_ui"),
    ("굳히다", "ko.palatalization"),
    ("많아", "ko.hieuh.vowel"),
    ("넋이", "ko.liaison.cluster"),
    ("API", "english.letter_names.v1"),
]


def test_changes(spark):
    got = run(spark, [a for a, _ in CHANGES], g2p_detail)
    for (text, rules), r in zip(CHANGES, got):
        assert " ".join(w.rule_id for w in r.rewrites) == rules, text
        assert all(w.rule_id in phonology.ARTICLES or w.stage != "phonology" for w in r.rewrites)
        now = r.normalized_text
        for w in r.rewrites:
            if w.stage == "phonology":
                assert now[w.start : w.end] == w.before
                now = now[: w.start] + w.after + now[w.end :]
        assert now == r.surface_pronunciation


def test_detail_with_tokens(spark):
    rows = spark.createDataFrame([("할 것을", [("할", "VV+ETM", 0, 1), ("것", "NNB", 2, 3), ("을", "JKO", 3, 4)])], "x string, k array<struct<form:string,tag:string,start:int,end:int>>")
    got = rows.select(g2p_detail(F.col("x"), analysis=F.col("k")).alias("d"), g2p(F.col("x"), analysis=F.col("k")).alias("g")).first()
    assert got.g == got.d.surface_pronunciation == "할 꺼슬" and got.d.complete
    assert [(w.rule_id, w.before, w.after) for w in got.d.rewrites] == [("ko.modifier.tensing.27", "할 것", "할 껏"), ("ko.liaison.single", "껏을", "꺼슬")]


def model(**changes):
    base = {
        "schema_version": 2, "feature_version": 3, "classes": list(classify.CLASSES), "bias": [0.0, 0.0, 0.0],
        "weights": {"u=번": [0.0, 2.0, -1.0], "len=4": [0.0, 0.0, 3.0]}, "thresholds": {"sino": {"unit": 0.6}},
    }
    return json.dumps(base | changes)


def test_classifier(spark):
    import math

    m = classify.parse_model(model())
    rows = spark.createDataFrame([(["u=번"],), (["len=4", "other"],), ([],)], "f array<string>")
    got = rows.select(classify.probabilities(F.col("f"), m).alias("p"), classify.decide(F.col("f"), "unit", "native", m).alias("d")).collect()
    e = [math.exp(x) for x in (0 - 2, 0, -1 - 2)]
    assert all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(got[0].p, e))
    assert [r.d for r in got] == ["sino", None, None]
    for bad in ({"schema_version": 1}, {"bias": [0.0, 1.0]}, {"bias": [0.0, 0.0, float("inf")]}, {"thresholds": {"sino": {"unit": 2}}}):
        with pytest.raises(ValueError):
            classify.parse_model(model(**bad))


CONTEXT = [
    ("사과 3개를 샀다", "사과/NNG/0 3/SN/3 개/NNB/4 를/JKO/5 샀/VV/7 다/EF/8", "사과 세 개를 샀다", ""),
    ("내 번호는 5566.", "내/NP/0 번호/NNG/2 는/JX/4 5566/SN/6 ./SF/10", "내 번호는 오 오 육 육.", ""),
    ("그 12번 창구", "그/MM/0 12/SN/2 번/NNB/4 창구/NNG/6", "그 십이 번 창구", ""),
    ("3번 문제를", "3/SN/0 번/NNB/1 문제/NNG/3 를/JKO/5", "삼 번 문제를", ""),
    ("1번째 100km/h", "1/SN/0 번째/XSN/1", "첫 번째 시속 백 킬로미터", ""),
    ("3개와 5개", "다른/NNG/0", "세 개와 다섯 개", "analyzer_failed"),
    ("7번", None, "일곱 번", "analyzer_unavailable"),
    ("2024년 3월 5일", None, "이천이십사 년 삼 월 오 일", ""),
]


def test_reading_by_context(spark):
    def parse(x):
        return None if x is None else [(f, tag, int(at), int(at) + len(f)) for f, tag, at in (y.split("/") for y in x.split())]

    weights = {"nc1=창구/NNG": [-6.0, 6.0, -6.0], "pf=는/JX": [-6.0, -6.0, 6.0]}
    m = classify.parse_model(model(weights=weights, thresholds={c: {"unit": 0.9, "bare": 0.9} for c in classify.CLASSES}))
    rows = spark.createDataFrame([(i, a, parse(b)) for i, (a, b, _, _) in enumerate(CONTEXT)], "i int, x string, k array<struct<form:string,tag:string,start:int,end:int>>")
    options = {"analysis": F.col("k"), "model": m}
    got = rows.select("i", normalize(F.col("x"), **options).alias("n"), convert(F.col("x"), **options).alias("c")).orderBy("i").collect()
    for (text, _, spoken, code), r in zip(CONTEXT, got):
        assert r.n == r.c.normalized_text == spoken, text
        assert ",".join(d.code for d in r.c.diagnostics) == code and r.c.complete
    with pytest.raises(ValueError):
        normalize(F.col("x"), model=m)


def test_features(spark):
    tokens = [("계좌번호", "NNG", 0, 4), ("뒷자리", "NNG", 5, 8), ("는", "JX", 8, 9), ("20", "SN", 10, 12), ("번", "NNB", 12, 13), ("은", "JX", 13, 14), ("빨강", "NNG", 15, 17)]
    rows = spark.createDataFrame([("계좌번호 뒷자리는 20번은 빨강", tokens)], "x string, k array<struct<form:string,tag:string,start:int,end:int>>")
    f = rows.select(classify.features(F.col("k"), F.col("x"), F.lit(10), F.lit(12), F.lit(14), F.lit("번")).alias("f")).first().f
    assert f == (
        "len=2 u=번 v=20 uv=번:20 sf=은/JX st=JX nf=빨강/NNG nt=NNG nc1=빨강/NNG un=번|빨강/NNG ln=2|빨강/NNG pf=는/JX pt=JX pc1=뒷자리/NNG pc2=계좌번호/NNG"
    ).split()
    weights = spark.createDataFrame([("len=2", [1.0, 2.0, 0.5])], "feature string, weights array<double>")
    keyed = spark.createDataFrame([(1, ["len=2", "x"]), (2, []), (3, ["y"])], "id int, f array<string>")
    m = {"bias": [0.0, 0.0, 0.0], "weights": {"len=2": [1.0, 2.0, 0.5]}}
    joined = {r.id: r.probabilities for r in classify.probabilities_by_join(keyed, "id", "f", weights, m["bias"]).collect()}
    assert joined == {r.id: r.p for r in keyed.select("id", classify.probabilities(F.col("f"), m).alias("p")).collect()}
