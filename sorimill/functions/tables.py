"""Fixed values of the written-to-spoken rules: word lists, readings, tables.

Everything in this module is data that results depend on, stated as text.
"""

from __future__ import annotations


def _pairs(text: str) -> dict[str, str]:
    """One entry a line: the key, two blanks or more, the reading."""
    out = {}
    for line in text.strip().splitlines():
        key, _, value = line.strip().partition("  ")
        out[key] = value.strip()
    return out


# Digits and powers.
SINO_DIGITS = "영일이삼사오육칠팔구"
PHONE_DIGITS = "공일이삼사오육칠팔구"
SMALL_POWERS = ("천", "백", "십", "")
LARGE_POWERS = ("", "만", "억", "조", "경", "해", "자", "양")
NATIVE_TENS = ("", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔")
NATIVE_ONES = ("", "한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉")
NATIVE_ALONE = ("", "하나", "둘", "셋", "넷", "다섯", "여섯", "일곱", "여덟", "아홉")
SCALES = {"십": 1, "백": 2, "천": 3, "만": 4, "억": 8, "조": 12}

# Counters read with native numerals.
NATIVE_COUNTERS = (
    "개 명 사람 마리 번째 시 배 가구 게임 건 세트 가지 개비 잔 번 장 병 권 벌 곳 시간 척 차례 바퀴 경기 골 살 달 글자 알 켤레 송이 컵 쪽 채 자루 그루 포기"
).split()

# Counters read with Sino-Korean numerals.
SINO_UNITS = (
    "초 분 일 주 개월 월 년 점 포인트 퍼센트 레벨 점수 등급 등 원 달러 유로 엔 파운드 회 차 기 호 페이지 도 층 학년 학기 학점 교시 세기 라운드 세 차원 위안 호실 동 단계 종"
).split()

# Written units and their readings.
UNIT_READINGS = _pairs("""
    km/h  킬로미터 퍼 아워
    ㎞/h  킬로미터 퍼 아워
    m/s  미터 퍼 세컨드
    km/s  킬로미터 퍼 세컨드
    MB/s  메가바이트 퍼 세컨드
    GB/s  기가바이트 퍼 세컨드
    W/kg  와트 퍼 킬로그램
    km/l  킬로미터 퍼 리터
    kg  킬로그램
    g/mL  그램 퍼 밀리리터
    g/ml  그램 퍼 밀리리터
    mg  밀리그램
    g  그램
    t  톤
    mL  밀리리터
    ml  밀리리터
    L  리터
    l  리터
    cm  센티미터
    mm  밀리미터
    km  킬로미터
    m  미터
    mi  마일
    mile  마일
    ha  헥타르
    ℓ  리터
    nm  나노미터
    μm  마이크로미터
    µm  마이크로미터
    m²  제곱미터
    cm²  제곱센티미터
    km²  제곱킬로미터
    ㎢  제곱킬로미터
    m³  세제곱미터
    cm³  세제곱센티미터
    km³  세제곱킬로미터
    ㎡  제곱미터
    ㎥  세제곱미터
    cc  씨씨
    kcal  킬로칼로리
    cal  칼로리
    kJ  킬로줄
    mmHg  수은주밀리미터
    Hz  헤르츠
    kHz  킬로헤르츠
    MHz  메가헤르츠
    GHz  기가헤르츠
    W  와트
    kW  킬로와트
    MW  메가와트
    Wh  와트시
    kWh  킬로와트시
    GWh  기가와트시
    V  볼트
    mV  밀리볼트
    mA  밀리암페어
    mAh  밀리암페어시
    dB  데시벨
    bpm  비피엠
    rpm  알피엠
    TEU  티이유
    FEU  에프이유
    ppm  피피엠
    dpi  디피아이
    KB  킬로바이트
    MB  메가바이트
    GB  기가바이트
    TB  테라바이트
    °C  도씨
    °c  도씨
    ℃  도씨
    ㎏  킬로그램
    ㎎  밀리그램
    ㎖  밀리리터
    ㎞  킬로미터
    ㎝  센티미터
    ㎜  밀리미터
    ㎾h  킬로와트시
    ㎿  메가와트
""")

# Speeds, whose reading puts the kind of speed first.
SPEED_UNITS = {"km/h": ("시속", "킬로미터"), "㎞/h": ("시속", "킬로미터"), "m/s": ("초속", "미터"), "km/s": ("초속", "킬로미터")}

# Unit signs that are read without a number.
STANDALONE_UNITS = "ℓ °C °c ℃ ㎡ ㎥ ㎏ ㎎ ㎖ ㎞ ㎝ ㎜ ㎢ ㎾h ㎿".split()

# Units after which context never changes the numeral.
CONTEXT_FREE_UNITS = [*SPEED_UNITS, *STANDALONE_UNITS, *"호실 동 단계 종 원 달러 유로 엔 파운드 위안".split()]

# Currencies.
CURRENCY_SIGNS = {"$": "달러", "₩": "원", "€": "유로", "£": "파운드", "¥": "엔"}
CURRENCY_CODES = {"KRW": "원", "USD": "달러", "EUR": "유로", "JPY": "엔", "CNY": "위안", "GBP": "파운드"}
CURRENCY_WORDS = sorted({*CURRENCY_SIGNS.values(), *CURRENCY_CODES.values()})

# Names of the consonant letters.
JAMO_NAMES = _pairs("""
    ㄱ  기역
    ㄲ  쌍기역
    ㄳ  기역시옷
    ㄴ  니은
    ㄵ  니은지읒
    ㄶ  니은히읗
    ㄷ  디귿
    ㄸ  쌍디귿
    ㄹ  리을
    ㄺ  리을기역
    ㄻ  리을미음
    ㄼ  리을비읍
    ㄽ  리을시옷
    ㄾ  리을티읕
    ㄿ  리을피읖
    ㅀ  리을히읗
    ㅁ  미음
    ㅂ  비읍
    ㅃ  쌍비읍
    ㅄ  비읍시옷
    ㅅ  시옷
    ㅆ  쌍시옷
    ㅇ  이응
    ㅈ  지읒
    ㅉ  쌍지읒
    ㅊ  치읓
    ㅋ  키읔
    ㅌ  티읕
    ㅍ  피읖
    ㅎ  히읗
""")

# Names of the Latin letters a to z.
LETTER_NAMES = dict(
    zip("abcdefghijklmnopqrstuvwxyz", "에이 비 씨 디 이 에프 지 에이치 아이 제이 케이 엘 엠 엔 오 피 큐 알 에스 티 유 브이 더블유 엑스 와이 지".split())
)

# Capitalised words with a reading of their own.
CONVENTIONAL_READINGS = _pairs("""
    AIDS  에이즈
    APEC  에이펙
    ASCII  아스키
    ASEAN  아세안
    BIOS  바이오스
    CCTV  씨씨티비
    CESCO  세스코
    COEX  코엑스
    DGIST  디지스트
    FEDEX  페덱스
    FIFA  피파
    FILA  휠라
    GIST  지스트
    IKEA  이케아
    KAIST  카이스트
    KATUSA  카투사
    KIA  기아
    KIST  키스트
    KOSDAQ  코스닥
    KOSPI  코스피
    LAN  랜
    LASEK  라섹
    LASER  레이저
    LASIK  라식
    MERS  메르스
    NASDAQ  나스닥
    NASA  나사
    NATO  나토
    NIMBY  님비
    OLED  올레드
    PASS  패스
    PAYCO  페이코
    PIN  핀
    POSTECH  포스텍
    PUBG  펍지
    RADAR  레이더
    RAM  램
    ROM  롬
    SARS  사스
    SCUBA  스쿠버
    SSGPAY  쓱페이
    TOEFL  토플
    TOEIC  토익
    TV  티비
    TVN  티비엔
    UNESCO  유네스코
    UNICEF  유니세프
    UNIST  유니스트
    USIM  유심
""")

# Words that are spelled by letter names.
INITIALISMS = (
    "AI API AR ASR BBC BC CD CEO CIA CNN CTO CPU DNA FAQ GPU HTTP HTTPS ID IT KTX LLM LTE MRI NLP OCR PDF QA RAG RNA ROI SNS SQL SSD STT TTS UI URL USB UX VR"
).split()

# Dates that name an event, and the event.
HISTORY = [
    ("3.1", "절"), ("3.1", "운동"), ("4.3", "사건"), ("4.3", "항쟁"), ("4.19", "혁명"),
    ("5.18", "민주화운동"), ("6.25", "전쟁"), ("8.15", "광복절"), ("10.26", "사건"),
]

# Labels in front of identifiers.
NUMBER_LABELS = "휴대폰 시리얼 전화 비밀 제품 카드 차량 인증 계좌 주문 식별 우편 팩스".split()
PLAIN_LABELS = "연락처 PIN 계좌 버스 번호 좌석 코드 호실".split()
NUMBERED_THINGS = "출구 버스 문제 문항 노선 좌석 채널".split()
EXTENSIONS = "json|ya?ml|toml|csv|tsv|txt|md|py|js|ts|wav|mp3|flac"

# Particles and endings that may follow a number or unit.
PARTICLES = (
    "가 간 과 까지 까지는 께 다 도 라고 라도 로 를 마다 만 밖에 보다 부터 부터는 당 에 에는 에게 에서 와 은 을 으로 의 이 이다 이었다 이라 이라고 이라도 이나 이고 인데 이며 이면 이지만 "
    "입니다 였다 처럼 는 쯤 씩 야 이야 랑 이랑 한테 한테서 조차 마저 뿐 로서 으로서 로써 으로써 라서 이라서 짜리 가량"
).split()

# Particles cut off behind a protected address.
ADDRESS_PARTICLES = (
    "에서만 에게만 한테만 으로만 부터만 까지만 에서는 에게는 한테는 으로부터 에게서 한테서 으로는 으로 에게 한테 부터 까지 에서 에는 은 는 이 가 을 를 에 의 와 과 도 만 로"
).split()

# Letters of a syllable in their order of composition.
ONSETS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
CODAS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

# A coda's sound where no vowel follows, with the article of the standard.
CODA_SOUNDS = {
    "ㄲ": "ㄱ", "ㅋ": "ㄱ", "ㅅ": "ㄷ", "ㅆ": "ㄷ", "ㅈ": "ㄷ", "ㅊ": "ㄷ", "ㅌ": "ㄷ", "ㅎ": "ㄷ", "ㅍ": "ㅂ",
    "ㄳ": "ㄱ", "ㄵ": "ㄴ", "ㄶ": "ㄴ", "ㄼ": "ㄹ", "ㄽ": "ㄹ", "ㄾ": "ㄹ", "ㅄ": "ㅂ",
    "ㄺ": "ㄱ", "ㄻ": "ㅁ", "ㄿ": "ㅂ", "ㅀ": "ㄹ",
}
# What stays and what moves when a vowel follows a double coda.
CLUSTER_LIAISON = {
    "ㄳ": "ㄱㅆ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅆ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅆ",
}
# Codas with ㅎ and what is left without it.
H_CODAS = {"ㅎ": " ", "ㄶ": "ㄴ", "ㅀ": "ㄹ"}
# What stays and what follows when a coda meets the onset ㅎ.
H_MERGERS = {
    "ㄱ": " ㅋ", "ㄲ": " ㅋ", "ㅋ": " ㅋ", "ㄳ": " ㅋ", "ㄺ": "ㄹㅋ", "ㄷ": " ㅌ", "ㅅ": " ㅌ", "ㅆ": " ㅌ", "ㅈ": " ㅌ", "ㅊ": " ㅌ",
    "ㅌ": " ㅌ", "ㄵ": "ㄴㅊ", "ㅂ": " ㅍ", "ㅍ": " ㅍ", "ㄼ": "ㄹㅍ", "ㄿ": "ㄹㅍ", "ㅄ": " ㅍ",
}
TENSE = {"ㄱ": "ㄲ", "ㄷ": "ㄸ", "ㅂ": "ㅃ", "ㅅ": "ㅆ", "ㅈ": "ㅉ"}
NASAL = {"ㄱ": "ㅇ", "ㄷ": "ㄴ", "ㅂ": "ㅁ"}
ASPIRATED = {"ㄱ": "ㅋ", "ㄷ": "ㅌ", "ㅈ": "ㅊ"}
# Numerals between which ㄴ is inserted.
SINO_BEFORE_SIX = "십백천만억"
NATIVE_BEFORE_YEO = "열물른흔쉰순든"


def longest_first(words) -> list[str]:
    return sorted(set(words), key=lambda w: (-len(w), w))


#: Units whose spoken form is written out in Hangul; 톤 is left out, as it has other meanings.
SPELLED_UNITS = sorted({r for r in UNIT_READINGS.values() if " " not in r} - {"톤"})
HANGUL_UNITS = longest_first([*NATIVE_COUNTERS, *SINO_UNITS, *SPELLED_UNITS])
ALL_UNITS = longest_first([*HANGUL_UNITS, *UNIT_READINGS])
