"""Word lists, patterns, weights and bounds whose values decide results."""

# Tokens per character, by script; the last is for every other character.
TOKEN_WEIGHTS = (
    ("ascii", "[\\x00-\\x7f]", 0.378),
    ("hiragana", "[぀-ゟ]", 0.735),
    ("katakana", "[゠-ヿｦ-ﾟ]", 0.592),
    ("kanji", "[一-鿿㐀-䶿豈-﫿]", 1.122),
    ("jp_punct", "[　-〿＀-･]", 1.198),
    ("other", None, 1.658),
)

# Recognition: head weights, stop-gram rule, gate, margin, characters of the body.
HEAD_WEIGHTS = {"name": 3.0, "word": 1.5, "char3": 1.0, "char2": 0.4, "body": 0.5}
STOP_MIN, STOP_SHARE = 3, 0.20
GATE, MARGIN, BODY_CHARS = 1.0, 1.15, 500
TOKEN = r":[0-9]{2,5}|[a-z][a-z0-9]*(?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)?|[ァ-ヿ]+"

# The evidence gate.
CLASSES = ("USER", "TOOL", "ACT", "SELF")
QUOTE_MIN, QUOTE_MAX, QUOTES = 12, 400, 6
CUE_MIN, CUE_MAX, CUES = 3, 40, 2
JUDGEMENT = r"(?i)judge|judgement|judgment|opinion|read it|見立て|判断"
FACT_AS_IDEA = r"(?i)\b(user|human|ken|owner|they)\b.{0,24}\b(proposed|approved|decided|asked|chose|said|confirmed|requested|wants|noted|instructed)\b"
HUMAN_CREDIT = (
    r"ケン(は|が|の指示|の決裁|さんが|確定|裁定|方針|決定|号令|決裁|指示|裁決|承認)",
    r"ケン\s*[:：]",
    r"\b(the user|the human|the owner|ken)\b\s+\w*\s*(decided|asked|approved|chose|instructed|said|ruled|confirmed)",
)
NUMBER = r"[+-]?\d+(?:\.\d+)?[eE][+-]?\d+|[+-]?\d[\d,.:/-]*\d|[+-]?\d"

# Tags.
TAG_SHAPE = r"^[a-z0-9][a-z0-9-]{0,39}$"
FORGETTING_TAGS = ("superseded", "absorbed", "fulfilled", "expired", "corrected", "released", "incidental")
ENTRUSTED = r"(?i)(remember (this|that|it)|don'?t forget|do not forget|keep (this|that|it) in mind|write (this|that|it) down|覚えて|忘れないで|記憶して|メモして|覚えておいて|覚えといて)"
FAILURE = r"(?i)(\berror\b|errno|exception|traceback|\bfail(ed|ure|s)?\b|fatal|panic|\boom\b|out of memory|timed? ?out|segfault|crash|killed|refused|denied|corrupt|broken|dead\b|落ち|失敗|死ん|壊れ|止まっ|エラー|例外|タイムアウト|固まっ|動かな)"
WARNING = r"(?i)(⚠|注意|警告|やめ|ダメ|駄目|違う|間違|禁止|危な|二度と|しないで|するな|don'?t\b|never\b|wrong|careful|warning|danger|\bstop\b|must not|mistake|not like that)"

# Floors.
MARKERS = (("⚠", "⚠️"), ("★", "★"))
NEGATION_EN = ("not", "no", "never", "none", "without", "cannot", "can't", "don't", "doesn't", "isn't", "aren't", "won't", "wasn't", "didn't", "must not")
NEGATION_JA = ("ではない", "するな", "しないで", "ません", "ない", "ぬ", "ず", "なく", "せず", "禁止", "不可", "未", "非", "不")
OBSOLETE = ("退役", "畳んだ", "撤退", "廃止", "廃案", "封印", "superseded", "deprecated", "retired", "abandoned", "obsolete", "撤収")
CODE_LIKE = r"[A-Za-z][A-Za-z0-9_+./-]{2,24}"
ARROW = r"(\S+)\s*(?:→|->|⇒)\s*(\S+)"
GROUNDED = 0.70
DEAD_WORDS = (
    "note", "notes", "memo", "summary", "overview", "detail", "details", "misc",
    "record", "records", "entry", "info", "information", "evaluation", "eval",
    "メモ", "概要", "説明", "記録", "要約", "一覧", "備考", "その他", "関連",
    "補足", "注記", "参考", "詳細", "内容", "要点", "まとめ", "作業", "試験",
    "テスト", "確認", "調査", "検討", "実装", "設計", "資料", "文書", "項目",
)

# Trims: where a clause ends, where a text may be cut, units of measurements, brackets.
CLAUSE = r"(?<=[。;；])\s*|(?<=\.)(?<!\d\.)(?:\s+|$)|\s+—\s+|\s+/\s+"
BREAKS = "。、．，・/｜|)）」』〕 \t"
NUMERAL = r"\d+(?:\.\d+)?[eE][+-]?\d+|\d[\d,.:/-]*\d|\d"
UNIT = r"(?:t/s|tok/s|GB|GiB|MB|KiB|TB|%|倍|秒|枚|層|件|ms|s|B)(?![A-Za-z])"
BRACKETS = (("(", ")"), ("[", "]"), ("（", "）"), ("「", "」"), ("『", "』"), ("〔", "〕"))
OPENING_CHARS = 600

# Typed edges, most specific first.
EDGE_TYPES = ("supersedes", "rejected", "blocked-by", "next", "continues")
SUPERSEDES = (*OBSOLETE, "旧")
REJECTED = ("却下", "不採用", "棄却", "rejected", "refuted", "撤回", "やめた", "採らない")
BLOCKED = ("blocked", "待ち", "止まって", "停止中", "blocked-by", "待機")
CONTINUES = ("続き", "継続", "継承", "continues", "後継", "再戦", "再開")
NEXT_START = ("次=", "次:", "next:", "次の一手")

# Layers, budgets, ladders.
TRIGGER_TOKENS, FRESH_DAYS, PINNED = 24, 14.0, ("feedback", "user")
FIT_LADDER = (14.0, 7.0, 3.0, 1.0, 0.0)
ADAPTIVE_LADDER = (8, 12, 16, 24)
TRAIL_TOKENS, GLANCE_TOKENS = 200, 150
WINDOW_TOKENS, WINDOW_SHARE, WINDOW_CEILING = 131072, 0.05, 0.20
RESOLVE_JACCARD = 0.4

# Intake.
SEGMENT_CHARS, TOOL_CHARS, LINE_BYTES, ID_CHARS, TIME_CHARS, CLASS_CHARS = 4000, 1500, 32768, 256, 40, 32
BATCH_CHARS, BATCH_LEAST = 200_000, 6_000
