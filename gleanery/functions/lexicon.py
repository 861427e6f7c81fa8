"""Fixed values of the retrieval rules: word lists, patterns and constants that results depend on."""

from __future__ import annotations

# Stop words.
STOPWORDS = (
    "은", "는", "이", "가", "을", "를", "에", "에서", "으로", "로",
    "와", "과", "도", "만", "및", "또는", "그리고", "하라", "하세요",
    "답하세요", "알려주세요", "나열하세요", "이상", "중", "시", "때",
    "경우", "대한", "대해", "함께",
)

# What makes a question one of each kind; the first that matches counts.
INTENTS = (
    ("list", r"나열|열거|종류|목록|항목|예시|\d+\s*가지|두\s*가지|세\s*가지|이상"),
    ("availability", r"24\s*시간|가능|되나요|됩니까|즉시|제한|필요|해야|바로|언제"),
    ("procedure", r"어떻게|방법|절차|신청하고 싶|조회하고 싶|변경|수정|재발급|확인|알고 싶|하고 싶"),
    ("definition", r"무엇인가요|무엇입니까|무슨|의미|개념|제도|용도"),
)

# Numerals in requests for a number of items.
NUMERALS = {
    "한": 1, "하나": 1, "두": 2, "둘": 2, "세": 3, "셋": 3, "네": 4, "넷": 4, "다섯": 5,
    "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10,
}
COUNTERS = "가지|개|종|명|항목"

# Literals of a question that its answer must repeat.
CRITICAL = ("즉시", "가능", "불가", "정지", "재발급", "조회", "변경", "수정")

# Negation, and conditions that are only positive.
NEGATION = r"없(?:는|을|어|습니다|나요|다면)?|아니|안\s*되|못\s*하|불가|제한"
POSITIVE_ONLY = r"있는\s*경우|가능합니다|가능하며|할\s*수\s*있"

# How a unit of an answer begins, and bullets.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
UNIT_START = r"^\s*(?:[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|\d+[\.)]|[‣∎•○●※*\-])\s*"
BULLETS = r"‣∎•○●"

# What raises or lowers a unit for each kind of question.
PROCEDURE_WORDS = "[①②③④⑤⑥⑦⑧⑨⑩]|클릭|입력|선택|접속|기재|인증|등록|조회|확인"
DEFINITION_WORDS = "입니다|있습니다|운영|제도|고유번호|의미|위하여"
DEFINITION_STEPS = "[①②③④⑤⑥⑦⑧⑨⑩]|클릭|입력|선택|접속"
AVAILABILITY_WORDS = "가능|불가|됩니다|있습니다|없습니다|제한|해야|즉시"
STRUCTURE_WORDS = r"방법|절차|경로|항목|종류|목록|이용\s*시|경우|단계|선택|조회|신청|발급"

# Planning.
IMPERATIVE_TAIL = r"(?:알려\s*주세요|답(?:하|해)세요|나열(?:하|해)세요|설명(?:하|해)세요)[?.!]*$"
CONNECTIVES = r"\s*(?:그리고|또한|및|와|과|,|;|/|\?|\.)\s*"
COMPREHENSIVE = "모두|전부|각각|나열|전체|가능한|방법들|경로들"

# Characters that do not count as noise, beside letters and digits.
CLEAN_MARKS = "().,:%/+-[]{}<>·ㆍ'\"!?？:;=~_#&*@₩☎ "

#: Word characters of the index.
WORD = "가-힣a-z0-9"

# Marks of an answer that count as spaces, and ranges of pages.
ANSWER_MARKS = r"""[·ㆍ\[\](){}<>‘’'"`*_#|,:;.!?→⇨/\\-]"""
PAGE_RANGE = r"(?i)(?:p\.?\s*)?\d+\s*[-~]\s*(?:p\.?\s*)?\d+"

# Which units an answer prefers.
KIND_PRIORITY = {"text": 0, "table": 1, "section": 2, "ocr": 8}
ROLE_PRIORITY = {"body": 0, "table": 1, "section": 2, "anchor_question": 9, "toc": 9}
ROLELESS = 3
