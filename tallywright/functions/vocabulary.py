"""Word lists and thresholds of the domain, in one place."""

# These lists decide results and are kept as they are, in their natural order.
CATEGORIES = ("국내주식", "해외주식", "원화예수금", "외화예수금", "국내채권", "해외채권", "펀드", "파생상품", "연금", "현금", "채권", "주식")
ACCOUNT_TYPES = (("IRP", "IRP"), ("ISA", "ISA"), ("연금저축", "연금저축"), ("퇴직", "IRP"), ("일반", "일반"))
DEFAULT_ACCOUNT_TYPE = "일반"
ACCOUNT_NICKNAMES = ("연금저축", "IRP", "ISA", "퇴직연금", "CMA", "중개형", "종합저축")
DEPOSIT_ECHOES = ("현금", "수표", "청약증거금", "접기", "접기›", "출금가능금액", "대용금")
CASH_ACCOUNT_WORDS = ("CMA", "현금", "예수금")
CASH_WORDS = ("예수금", "예금", "현금", "CMA")
ASSET_CLASSES = (
    (("나스닥", "S&P", "성장", "테크", "AI", "반도체", "휴머노이드", "소프트웨어"), "성장주"),
    (("고배당", "배당"), "배당주"),
    (("채권혼합",), "혼합(주식·채권)"),
    (("채권",), "채권"),
    (("금현물", "원자재", "금선물"), "금·원자재"),
    (("리츠", "부동산"), "부동산"),
    (("예수금", "현금", "CMA", "예금", "증거금"), "현금"),
)
HEADERS = {
    "pnl": ("평가손익", "손익", "평가손실"),
    "rate": ("수익률", "손익률", "등락률"),
    "cost": ("매수금액", "매입금액", "매입원금", "취득금액"),
    "value": ("평가금액", "평가액", "잔고", "평가"),
    "qty": ("수량", "보유수량", "잔고수량"),
    "cost_unit": ("매수단가", "평균단가", "매입단가", "평단"),
    "price": ("현재가", "단가"),
    "name": ("종목명", "상품명", "종목"),
}
HEADER_CATEGORIES = ("구분", "유형", "상태")
INDEX_WORDS = ("코스피", "KOSPI", "코스닥", "KOSDAQ", "애프터마켓", "장마감", "장중", "다우", "나스닥종합", "S&P500지수")
FIELD_LABELS = ("출금가능", "총자산", "총 자산", "신용", "대출", "예상금액")
FIELD_LABELS_EXACT = ("원금", "총수익", "총 수익", "일간수익", "일간 수익", "총투자금", "총 투자금", "내투자", "내 투자", "투자금")
ACCOUNT_HINTS = ("연금", "IRP", "ISA", "퇴직", "CMA", "중개형", "비대면", "저축", "종합", "위탁", "일반")
BROKER_STOP_WORDS = ("이", "그", "한", "본", "저", "위", "및", "해당", "관련", "증권사")
PLACEHOLDERS = (
    "증권사명", "증권사", "브랜드", "브랜드명", "계좌", "계좌명", "계좌유형", "종목명", "상품명", "이름", "null", "none", "n/a", "na",
    "-", "미상", "알수없음", "unknown", "broker", "brokername", "string", "값", "없음", "○○증권", "△△전자",
)
CARD_TOTALS = ("자산", "총자산", "총 자산", "평가금액", "평가액", "원화예수금", "외화예수금", "보유주식", "내투자", "내 투자")
CONFUSABLE = ("VWUY", "Il1T", "O0DQ", "S5", "B8", "G6C", "Z2", "PR", "EF", "MN", "XK")
REPEATED_STROKES = "VWIl1"
ROW_FIELDS = ("broker", "accountType", "name", "assetClass", "currency", "qty", "price", "value", "cost", "pnl", "confidence")

# Thresholds.
LINE_TOLERANCE, BAND_MERGE = 0.6, 1.7
JUMP_RATIO, JUMP_MASS = 1.8, 0.25
PHRASE_OVERLAP, PHRASE_RATIO = -0.2, 1.0
TOTAL_ROW, DEPOSIT_ANCHOR, OWNER_BAND, CROSS_CHECK, SAME_VALUE, REFUTED = 0.02, 0.01, 0.02, 0.02, 0.005, 0.10
SLIP_BROKEN, SLIP_FIXED, SLIP_FACTORS = 0.01, 0.001, (0.1, 0.01, 10.0, 100.0)
QTY_BLANK, QTY_SURE, QTY_GROSS, SYMBOL_GATE = 1 / 3, 0.10, 0.35, 0.10
IDENTITY, DISPLAY, FOREIGN_CASH = 0.001, 0.02, 0.02
FX_LOW, FX_HIGH = 500.0, 3000.0
DOLLAR_CASH, WON_CASH = 1e6, 1e5
PITCH_SHARE, PITCH_LEAST, PITCH_HEIGHTS = 0.60, 1.6, 4.0
TOP_LINES, SUM_MATCH = 8, 0.02
GOLDEN_VALUE, GOLDEN_PRICE, GOLDEN_MATCH = 0.01, 0.02, 0.005
STALE_DAYS, WIDE_RANGE_DAYS = 4, 80
NAME_SUPPORT, NAME_LETTERS = 0.6, 4
MAX_VARIANTS = 48
#: (age in days at most, interval) of intraday bars, finest first.
INTRADAY = ((7, "1m"), (29, "5m"), (55, "15m"), (90, "1h"))
#: UTC hours of session open and close by currency.
SESSIONS = {"USD": (13.5, 20.0), "KRW": (0.0, 6.5)}
