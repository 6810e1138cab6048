"""Word lists, patterns and constants that results depend on."""

#: File kinds that are searched and organised.
EXTENSIONS = ("pdf", "docx", "doc", "pptx", "ppt", "hwpx", "hwp")

#: Kinds of files that are read as plain text; fixed values.
PLAIN_KINDS = ("txt", "md", "py", "sql", "json", "html", "xml", "yaml", "yml")

#: Characters that join the parts of a file name.
NAME_SEPARATORS = "_-.()[]{}·,~"

#: Words of a query that say nothing about the document; file kinds are added.
STOPWORDS = (
    "찾아줘", "찾아주라", "찾아봐", "찾아", "찾기", "찾아볼래",
    "검색", "검색해", "검색해줘", "보여줘", "보여주라", "알려줘", "열어줘",
    "관련", "관련된", "대한", "대해",
    "있나", "있어", "있는", "있는지", "있을까", "없나",
    "어디", "어디에", "어딨어", "어딨지", "뭐지", "뭐더라",
    "이거", "그거", "저거", "요거", "나의", "해줘", "주세요",
    "파일", "문서", "자료", "폴더", "파일들", "문서들", "자료들",
) + EXTENSIONS

#: Time phrases in the order they are looked for, and their half-life in days.
TIME_PHRASES = (
    ("그저께", 3.0), ("엊그제", 3.0), ("어제", 3.0), ("오늘", 2.0),
    ("얼마 전", 14.0), ("얼마전", 14.0),
    ("지난 주", 10.0), ("지난주", 10.0), ("저번주", 10.0), ("이번주", 7.0),
    ("지난 달", 45.0), ("지난달", 45.0), ("저번달", 45.0), ("이번달", 30.0),
    ("요즘", 14.0), ("최근", 30.0), ("최신", 30.0),
)

#: Particles at the end of a word, in the order they are tried.
PARTICLES = ("에서", "으로", "이랑", "라는", "까지", "부터", "하고", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "들")

#: Document categories and what they are called; the last one abstains.
CATEGORIES = {
    "lecture": "강의자료",
    "assignment": "과제",
    "report": "실험·보고서",
    "reference": "참고자료",
    "project": "프로젝트",
    "exam_prep": "시험 준비",
    "career": "취업·진로",
    "admin": "행정 서류",
    "personal": "개인",
    "etc": "기타",
}
#: The document type that a category puts into a file name.
DOCUMENT_TYPES = {
    "lecture": "강의자료",
    "assignment": "과제",
    "report": "보고서",
    "reference": "참고자료",
    "project": "프로젝트",
    "exam_prep": "시험정리",
    "career": "취업문서",
    "admin": "행정문서",
    "personal": "개인문서",
    "etc": "기타",
}
#: Folder names that stand for a category, lower case.
FOLDER_ALIASES = {
    "lecture": "lecture", "강의자료": "lecture", "강의": "lecture",
    "assignment": "assignment", "과제": "assignment",
    "report": "report", "보고서": "report", "실험보고서": "report",
    "reference": "reference", "논문": "reference", "참고자료": "reference",
    "project": "project", "프로젝트": "project",
    "exam_prep": "exam_prep", "시험정리": "exam_prep", "시험": "exam_prep",
    "career": "career", "자소서": "career", "취업": "career",
    "admin": "admin", "행정": "admin", "학사": "admin",
    "personal": "personal", "개인": "personal", "생활": "personal",
    "etc": "etc", "기타": "etc",
}
#: (document type, work mode) to the category of a generated corpus.
CATEGORY_RULES = {
    ("과제", "개인"): "assignment",
    ("과제", "팀"): "team_project",
    ("보고서", "개인"): "essay",
    ("보고서", "팀"): "assignment",
    ("프로젝트", "개인"): "project",
    ("프로젝트", "팀"): "team_project",
    ("설계 문서", "개인"): "project",
    ("설계 문서", "팀"): "reference",
    ("실험 결과", "개인"): "practice",
    ("실험 결과", "팀"): "practice",
    ("조사 자료", "개인"): "research",
    ("조사 자료", "팀"): "research",
    ("발표 초안", "개인"): "lecture",
    ("발표 초안", "팀"): "lecture",
    ("논문 요약", "개인"): "reference",
    ("논문 요약", "팀"): "essay",
}
#: Terms that mean the same.
TERM_GROUPS = (("인공지능", "AI"), ("운영체제", "OS"), ("데이터베이스", "DB"), ("컴퓨터네트워크", "네트워크", "NETWORK"))
#: Words that alone do not support a subject or topic.
WEAK_WORDS = ("문서", "자료", "최종", "과제", "강의자료", "보고서", "참고자료", "프로젝트", "시험정리", "취업문서", "행정문서", "개인문서", "기타")
#: File names that a system keeps for itself.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
#: What stands between the sampled parts of a long text.
ELISION = "\n… [중간 생략] …\n"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
ILLEGAL = r'[\\/:*?"<>|]'
READABLE = "·※…—–「」『』()%,."

# Retrieval weights (vector, keyword, recency) and limits.
WEIGHTS, WEIGHTS_WITH_TIME = (0.55, 0.40, 0.05), (0.40, 0.32, 0.28)
VECTOR_FLOOR, RELATIVE_CUT, COMBINED_CUT = 0.35, 0.75, 0.75
BODY_WEIGHT, NAME_THRESHOLD, HALF_LIFE = 0.7, 0.5, 30.0
# Classification limits.
LABEL_THRESHOLD, EXAMPLE_THRESHOLD, NEIGHBOURS = 0.35, 0.55, 3

METHOD_LABELS = {"user_knn": "사용자 승인 예시 기반", "label_zeroshot": "라벨 정의문 유사도", "etc_fallback": "분류 보류(기타)", "knn": "k-NN 다수결"}
