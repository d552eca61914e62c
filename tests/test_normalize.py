"""Golden rows of the written-to-spoken rules and their cross-cutting properties."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from sorimill.operators import lexicon
from sorimill.operators.normalize import convert, diagnostic_log, normalize, protected, rewrite_log

NFD = lambda s: unicodedata.normalize("NFD", s)

SPOKEN = """
값은 0입니다. => 값은 영입니다.
참가자는 12,345명입니다. => 참가자는 만이천삼백사십오 명입니다.
정확도는 12.5%입니다. => 정확도는 십이 점 오 퍼센트입니다.
3마리 => 세 마리
가격은 ₩1,200입니다. => 가격은 천이백 원입니다.
250mL => 이백오십 밀리리터
1~3개 => 하나에서 세 개
40~100m => 사십에서 백 미터
1시간~2시간 => 한 시간에서 두 시간
5만원~10만원 => 오만 원에서 십만 원
4억~5억 원을 => 사억에서 오억 원을
6월은 => 유월은
3.1절 => 삼일절
AI와 GPU => 에이아이와 지피유
NASA와 FIFA => 나사와 피파
10ml의 => 십 밀리리터의
ㄳ => 기역시옷
1.5조 원 => 일조오천억 원
남은 건 5개뿐이다. => 남은 건 다섯 개뿐이다.
속도는 100km/h다. => 속도는 시속 백 킬로미터다.
오후 3:05:07 => 오후 세 시 오 분 칠 초
13:00~14:30 => 십삼 시 영 분에서 십사 시 삼십 분
2026. 8. 7.입니다 => 이천이십육 년 팔 월 칠 일입니다
2024 년 2 월 29 일 => 이천이십사 년 이 월 이십구 일
0507-1234-5678 => 공 오 공 칠 일 이 삼 사 오 육 칠 팔
KRW 1000원 => 천 원
-3~-1℃ => 마이너스 삼에서 마이너스 일 도씨
119에 신고 => 일 일 구에 신고
112 페이지를 참고하라 => 백십이 페이지를 참고하라
10^-5 => 십의 마이너스 오승
4.19 혁명 => 사일구 혁명
제2장 => 제 이 장
1번째 => 첫 번째
200여 m => 이백여 미터
2/5kg => 오분의 이 킬로그램
몇 mg 넣어야 해? => 몇 밀리그램 넣어야 해?
kg당은 => 킬로그램당은
㎢ => 제곱킬로미터
1조 원은 큰돈이다. => 일조 원은 큰돈이다.
1.6~3.3m/s => 초속 일 점 육에서 삼 점 삼 미터
1kg – 3kg => 일 킬로그램에서 삼 킬로그램
1~2만원 => 일에서 이만 원
5 EUR유로 => 오 유로
3번 출구 => 삼 번 출구
24시 00분 => 이십사 시 영 분
010.1234.5678 => 공 일 공 일 이 삼 사 오 육 칠 팔
088-1452-3265로 => 공 팔 팔 일 사 오 이 삼 이 육 오로
매일 5킬로미터를 달렸다. => 매일 오 킬로미터를 달렸다.
값은 2. => 값은 이.
"""

KEPT = """
SUSBtype
10calmly
ㅋㅋ
https://example.com/v1.2?q=3에서 확인하세요.
user@example.com으로 보내세요.
고유명사 Minnie를 부른다.
주문번호 AB12를 확인한다.
漢字를 확인한다.
범위 1-3개를 확인한다.
1.2.3
2026-08/07
01/2
3.3XYZ
12345678901.5
25:00
2024년 2월 30일
13월
USD 5원
카드번호 1234 5678 9012 3456 99
2 1/2kg
+82 10 123 45678
3월 1일~3월 5일까지
가격은 €5.000이다.
1 ~ 3개발
1$2.
①3
1 / 2
H2O
Wi-Fi
37T5L
3시스템
10000000000개
kg 단위
120/80mmHg
1시~2시간
1시부터~2시
12:00-13:00
2024-01-01 – 2024-01-31
0021 2832 5344 3074번 카드
010-1234-5678 2024년
31~1H>3
M>0V
/H>3
+€12,345kg
𝟙₩1
AI시01MHz$5시
행사에 3.000만 원이 든다.
5마일리지 적립
foo_USB_bar
foo.10ml.bar
10±2kg
1e+3
"""

ROWS = [tuple(x.split(" => ")) for x in SPOKEN.strip().splitlines()]
WHOLE = KEPT.strip().splitlines()


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_golden_rows(spark):
    got = run(spark, [a for a, _ in ROWS], convert)
    assert [r.normalized_text for r in got] == [b for _, b in ROWS]
    assert all(r.rewrites and r.rewrites[0].rule_id.startswith("normalizer.") for r in got)
    for (source, spoken), r in zip(ROWS, got):
        built, at = "", 0
        for w in r.rewrites:
            assert source[w.start : w.end] == w.before
            built, at = built + source[at : w.start] + w.after, w.end
        assert built + source[at:] == spoken


def test_kept_rows(spark):
    got = run(spark, WHOLE, convert)
    assert [r.normalized_text for r in got] == WHOLE
    for source, r in zip(WHOLE, got):
        assert r.complete == source.startswith(("https", "user@")), source
        assert r.complete == (not r.diagnostics) and not r.rewrites


def test_spoken_text_is_a_fixed_point(spark):
    spoken = [b for _, b in ROWS] + WHOLE
    assert run(spark, spoken, normalize) == spoken


def test_edges_and_policies(spark):
    texts = [None, "", "한글만 있습니다.", "a\x01b\x1f3개", "9." * 2000, "1$" * 2000]
    got = run(spark, texts, normalize)
    assert got[:3] == texts[:3] and got[4:] == texts[4:] and got[3].startswith("a\x01b\x1f")
    kept = run(spark, ["Minnie"], lambda c: convert(c, on_ambiguous="preserve"))[0]
    assert not kept.complete and kept.diagnostics == []
    with pytest.raises(Exception, match="no certain reading"):
        run(spark, ["Minnie"], lambda c: convert(c, on_ambiguous="error"))
    with pytest.raises(Exception, match="longer than 5"):
        run(spark, ["123456"], lambda c: normalize(c, max_length=5))
    for bad in (0, "x"):
        with pytest.raises(ValueError):
            normalize(F.col("x"), max_length=bad)
    with pytest.raises(ValueError):
        convert(F.col("x"), on_ambiguous="maybe")


def test_logs(spark):
    df = spark.createDataFrame([(1, "3개와 Tom"), (2, "없음")], "i int, x string")
    assert [(r.i, r.before, r.after) for r in rewrite_log(df, "x", "i").collect()] == [(1, "3개와", "세 개와")]
    assert [(r.i, r.code) for r in diagnostic_log(df, "x", "i").collect()] == [(1, "unconverted_latin")]


def test_protected_pieces(spark):
    texts = ["`코드 3개` 밖", "(https://a.b/c?d=1.) 끝", "C:\\a\\b.txt로", "./x/y.py에서 3개", "메일 a.b@c.de로"]
    got = run(spark, texts, lambda c: F.get(protected(c), F.lit(1)))
    assert got == ["`코드 3개`", "https://a.b/c?d=1", "C:\\a\\b.txt", "./x/y.py", "a.b@c.de"]


#: Text and its protected pieces.
PIECES = [
    ("https://example.com/path에서만 user@example.com에서만 확인", ["https://example.com/path", "user@example.com"]),
    (r"``5개`` https://example.com/a(5) C:\Program Files\App 2\run.exe", ["``5개``", "https://example.com/a(5)", r"C:\Program Files\App 2\run.exe"]),
    (r"open \\server\share\5kg\m.wav now", [r"\\server\share\5kg\m.wav"]),
    (r"models\2026-08-07\5kg\m.wav를 확인", [r"models\2026-08-07\5kg\m.wav"]),
    (r".\models\5kg\m.wav ..\a\b.c ../../x/y", [r".\models\5kg\m.wav", r"..\a\b.c", "../../x/y"]),
    (r"escape \n and \t, A\B and/or 290㎞/h", []),
    ("https://a.b/c\u200bd", ["https://a.b/c"]),
    ("root\\" + "\\".join(f"part{i}" for i in range(1000)), ["root\\" + "\\".join(f"part{i}" for i in range(1000))]),
    ("$" * 9000 + r"\a\b", ["$" * 9000 + r"\a\b"]),
]


def test_protected_structure(spark):
    got = run(spark, [a for a, _ in PIECES], protected)
    assert [[p for i, p in enumerate(g) if i % 2] for g in got] == [b for _, b in PIECES]


def test_marks_come_back(spark):
    odd = "\x01\x02\x03\x04\x1f\ue001\ue004\ue01f\ufdd0\ufdd4\ufdd6\ufdd8\ufde0"
    texts = [odd + " 3개" + odd, f"https://a.b/{odd} 3개", odd + " " * 9000 + "국물"]
    got = run(spark, texts, lambda c: F.struct(normalize(c).alias("n"), convert(c).alias("c")))
    for t, r in zip(texts, got):
        assert r.n == r.c.normalized_text
        assert r.n.replace("세 개", "3개") == t
    codes = [(d.start, d.end, d.code) for d in got[0].c.diagnostics]
    assert codes == [(0, 4, "unsupported_character"), (5, 13, "unsupported_character")]  # U+001F counts as a blank


def test_later_gaps_are_not_reported(spark):
    got = run(spark, ["① ☃ Tom ☃ `x` ☃", "☃ 3개 é ☃"], convert)
    assert [(d.start, d.code) for d in got[0].diagnostics] == [(0, "ambiguous_numeric"), (4, "unconverted_latin"), (14, "unsupported_symbol")]
    assert [(d.start, d.code) for d in got[1].diagnostics] == [(0, "unsupported_symbol")]
    assert run(spark, ["USB\u0301"], convert)[0].diagnostics[0].code == "unsupported_script"


def both(spark, texts, entries):
    """The same by the scan and by the automaton."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    inline = [r.y for r in df.select("i", lexicon.normalize_with(F.col("x"), entries).alias("y")).orderBy("i").collect()]
    m = lexicon.with_matches(df, "x", entries)
    joined = m.select("i", "matches", lexicon.normalize_matched(F.col("x"), F.col("matches")).alias("y")).orderBy("i").collect()
    assert [r.y for r in joined] == inline
    return inline, [r.matches for r in joined]


def test_lexicon(spark):
    entries = {"G20": "지이십", "3개월": "석 달", "서울": "서울시", "08": "공팔", "kg": "키로", "X": "5개", "KRAFTON": "크래프톤"}
    texts = ["G20과 3개월", "XG20 서울역 서울", "https://G20/x", "2026-08-07", "3 kg", "a\x01b 3개", "\x03가 3개", "X는", None, "KRAFTON은 회사다.", NFD("서울")]
    got, _ = both(spark, texts, entries)
    assert got[:3] == ["지이십과 석 달", "XG20 서울역 서울시", texts[2]]
    assert got[3:5] == ["이천이십육 년 팔 월 칠 일", "삼 킬로그램"]
    assert got[5:] == ["a\x01b 세 개", "\x03가 세 개", "다섯 개는", None, "크래프톤은 회사다.", "서울시"]
    text = "XAI AI2 AI는 신서울 서울역 서울 출발 API와 AI, A!"
    _, found = both(spark, [text], {"A": "에이", "AI": "에이아이", "API": "에이피아이", "서울": "서울특별시"})
    assert [(m.start, m.end, m.key) for m in found[0]] == [(8, 10, "AI"), (20, 22, "서울"), (26, 29, "API"), (31, 33, "AI"), (35, 36, "A")]
    for bad in ({"": "x"}, {"a": "b\x00"}, {"가": "x", "\u1100\u1161": "y"}, ["a"], {"키\ud800": "값"}, {"키": "값\u200b"}, {1: "a"}):
        with pytest.raises(ValueError):
            lexicon.check_entries(bad)
    for limits in ({"max_key": 1}, {"max_value": 1}, {"max_entries": 1}, {"max_total": 4}, {"max_key": True}, {"max_total": 0}):
        with pytest.raises(ValueError):
            lexicon.check_entries({"AB": "가나", "CD": "다"}, **limits)
    with pytest.raises(ValueError, match="final"):
        lexicon.compiled(spark, {"A": "B2B"})
    table = spark.createDataFrame([("a", "세 개"), ("b", "3개")], "key string, value string")
    assert [r.key for r in lexicon.unstable_entries(table).collect()] == ["b"]
    with pytest.raises(Exception, match="longer than 5"):
        run(spark, ["12345"], lambda c: normalize(c, max_output=5))
