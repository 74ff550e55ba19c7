"""Word lists and patterns of the retrieval signals, the planner and the computation parser."""

# --- fixed values: results depend on these exact words ---
SUMMARY_QUERY = ("讲什么", "讲了什么", "说什么", "说了什么", "主要内容", "总结", "概括", "摘要", "介绍一下", "this document", "summarize", "summary", "overview")
SUMMARY_SECTION = ("摘要", "概述", "概要", "总结", "主要内容", "executive summary", "overview", "summary")
PROCESS_QUERY = ("如何", "怎么", "怎样", "流程", "步骤", "办理", "操作", "谁审批", "谁复核", "how to", "procedure", "steps", "workflow")
PROCESS_TEXT = ("流程", "步骤", "操作", "办理", "申请", "审批", "复核", "提交", "procedure", "steps", "workflow")
TIME_QUERY = ("多久", "几天", "多少天", "多长时间", "什么时候", "何时", "时限", "期限", "有效期", "提前", "how long", "when", "deadline", "duration")
QUANTITY_QUERY = ("多少", "几个", "几家", "几次", "金额", "比例", "百分比", "how much", "how many", "percentage", "amount")
DEADLINE_TEXT = ("内", "前", "后", "到期", "截止", "有效期", "不超过", "至少提前", "within", "before", "after", "deadline", "expires")
TIME_VALUE = (
    r"(?i)(?:\d+(?:\.\d+)?|[零一二三四五六七八九十百千万两]+)\s*"
    r"(?:分钟|小时|个?工作日|个?自然日|天|周|星期|个月|月|季度|年|minutes?|hours?|business days?|calendar days?|days?|weeks?|months?|quarters?|years?)"
)
NUMBER_VALUE = r"\d|[零一二三四五六七八九十百千万两]\s*(?:%|％|元|万元|亿元|个|家|次|条|人|份|台|套)"
URL = r"(?i)https?://|www\."
EMAIL = r"(?i)\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b"
PAGE_NUMBER_LINE = r"(?i)^(?:第\s*)?\d+\s*(?:页|/\s*\d+)?$|^page\s+\d+(?:\s+of\s+\d+)?$"

COUNT_FILES = ("几个", "多少个", "几份", "数量", "how many")
LIST_FILES = ("有哪些文件", "有什么文件", "文件列表", "列出", "都有哪些", "有哪些")
SUMMARY_WANTED = ("有什么", "包含什么", "有哪些内容", "主要内容", "什么内容", "主要讲了什么", "讲了什么", "讲什么", "说了什么", "哪些列", "字段", "列名", "概览", "总结", "摘要", "分别", "各自")
ALL_FILES = ("所有", "全部", "分别", "各自", "我的")
TABLE_SCOPE = ("表里", "表中", "表格里", "表格中", "excel表")
FILE_WORDS = ("文件", "文档", "资料", "知识库")
TYPE_WORDS = (
    (".xlsx", ("excel", "xlsx", "工作簿", "电子表格")),
    (".csv", ("csv",)),
    (".pdf", ("pdf",)),
    (".md", ("markdown", "md文件")),
    (".txt", ("txt", "文本文件")),
)
SUM = ("求和", "合计", "总和", "加起来", "总额", "总计", "一共")
AVG = ("平均", "均值", "平均值", "人均")
MAX = ("最大", "最高", "最多", "峰值")
MIN = ("最小", "最低", "最少", "谷值")
COUNT_ROWS = ("有几条", "多少行", "多少条", "几条", "几行", "条数", "计数")
FILTER = ("超过", "大于", "高于", "达到", "不低于", "少于", "小于", "低于", "不足")
COMPARISONS = {"超过": "gt", "大于": "gt", "高于": "gt", "达到": "ge", "不低于": "ge", "少于": "lt", "小于": "lt", "低于": "lt", "不足": "lt", ">=": "ge", "<=": "le", ">": "gt", "<": "lt"}
CONDITION = r"(超过|大于|高于|达到|不低于|少于|小于|低于|不足|>=|<=|>|<)\s*([\d.,]+%?)"
GROUP_MAX = ("最高", "最大", "最多")
GROUP_MIN = ("最低", "最小", "最少")
CROSS_FILE = ("所有", "全部", "每个", "各文件", "各表")
MIXED_JOIN = ("和", "以及", "还有", "并且", "同时", "+")
MIXED_CONTENT = ("怎么", "如何", "规定", "制度", "流程", "说明", "要求", "是什么", "情况")
FOLLOWUP = (
    "它", "他", "她", "这个", "那个", "这些", "那些", "上面", "前面", "刚才", "之前", "第一个", "第二个", "第三个", "前面那个", "再", "还有", "另外", "别的",
    "哪个文档", "哪个文件", "哪个来源", "哪个资料", "什么文档", "什么文件", "出处", "来源", "引用", "哪份",
    "为什么失败", "为什么报错", "为什么错误", "为什么不行", "为什么错", "怎么回事", "为什么出错", "失败的原因", "报错原因",
    "为什么不回答", "为什么没回答", "为什么没有回答", "为什么不回", "为什么不回复", "怎么不回答",
)
CLARIFYING = ("请指定", "请说明", "请选择", "检测到文件内多个", "不明确", "无法确定", "请补充")
QUESTION_WORDS = ("？", "?", "什么", "如何", "怎么", "为什么", "多少", "哪", "请", "分别", "几")
NO_ANSWER = "当前资料不足以回答。请换一种更明确的说法，或补充相关文档后再问。"
# Redaction, applied in this order
SECRETS = (
    r"(?i)Authorization\s*:\s*Bearer\s+[A-Za-z0-9._~+/= -]+",
    r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"sk-[A-Za-z0-9_-]{8,}",
    r"(?i)(api[_-]?key|apikey|secret|access[_-]?token|token)\s*[=:]\s*[\"']?[A-Za-z0-9._~+/=-]{4,}",
)
# Layout
LAYOUT_PAGE_NUMBER = r"(?i)^(?:第\s*)?(?:\d+|[一二三四五六七八九十百千万]+)\s*(?:页)?(?:\s*/\s*\d+)?$|^page\s+\d+(?:\s+of\s+\d+)?$"
CHAPTER = r"^第[一二三四五六七八九十百千万0-9]+[章节篇部分]"
NUMBERED_HEADING = r"^([1-9]\d{0,2}(?:\.[0-9]{1,2}){0,3})(?:\s*[\s、.)．]|(?=[\x{4e00}-\x{9fff}A-Za-z]))"
CHINESE_HEADING = r"^[一二三四五六七八九十百千万]+[、.)．]"
FIGURE_CAPTION = r"(?i)^(?:图|fig\.?|figure)\s*[\d一二三四五六七八九十]+(?:[-.－—]\d+)*"
TABLE_CAPTION = r"(?i)^(?:表|table)\s*[\d一二三四五六七八九十]+(?:[-.－—]\d+)*"
DOI = r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi\s*[:：]?\s*)?10\.\d{4,9}/[-._;()/:A-Z0-9]+"
# --- end of fixed values ---
