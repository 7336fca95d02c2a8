"""Labels, word lists, lookup tables and patterns.

Everything here is data that results depend on.  It is stated in natural order and read by the column builders in
``functions``; none of it is logic.
"""

from __future__ import annotations

# --- fixed values: the label system ---------------------------------------------------------------------------------

# id, name, level
LABELS = [
    (0, "normal_clause", "无风险"),
    (1, "payment_risk", "高风险"),
    (2, "tax_invoice_risk", "中风险"),
    (3, "delivery_acceptance_risk", "中风险"),
    (4, "liability_penalty_risk", "中高风险"),
    (5, "financial_compliance_risk", "高风险"),
]
REJECTED = (-1, "非合同条款", "无法判断")
REJECT_MESSAGE = "输入内容不像是合同条款，请输入有效的合同文本后再试"
NUM_LABELS = 6
HIGH_RISK_LABELS = (1, 5)
HIGH_RISK_RECALL = 0.92

DATASET_COLUMNS = ["id", "text", "label", "source", "confidence"]
SOURCES = [
    ("bid_contract_samples.jsonl", "bid"),
    ("cj_processed.jsonl", "court_judge"),
    ("syn_processed.jsonl", "synthetic"),
]
DEFAULT_CONFIDENCE = 0.75
SAMPLE_SOURCE = "gov_bid_file"
SPLIT_SEED = 42

# --- fixed values: text cleaning ------------------------------------------------------------------------------------

# What Python's str.strip() and \s treat as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Private-use characters do not display and are written as escapes.
NOISE_SYMBOLS = "\uf0a8\uf0fe\uf0fc\uf0d8\uf0b7\uf0a7\uf020☐☑☒□■▣◇◈✓✔✗✘❓❔\ufe00\ue007"
PRIVATE_USE = "\uf000-\uf0ff"
COLLAPSING_PUNCTUATION = "。！？，、；：」』）)"
FILENAME_FORBIDDEN = '\\/:*?"<>|\r\n\t'
UNNAMED = "unnamed"
CLAUSE_SEPARATOR = r"\p{Nd}+\.\p{Nd}+|（\p{Nd}+）|；"
SENTENCE_SEPARATOR = r"[。；;\n]+"
MIN_SENTENCE = 5
CLAUSE_BAND = (15, 130)
LABEL_BAND = (18, 120)

# --- fixed values: contract documents -------------------------------------------------------------------------------

PARAGRAPH_KEEP = ["政府采购合同", "合同通用条款", "合同专用条款", "货款", "价款", "付款", "保证金", "质保金", "增值税发票", "验收", "逾期", "违约金"]
PARAGRAPH_DROP = ["投标人须知", "技术参数", "规格型号", "评分标准", "资格审查", "报价清单", "图纸", "维保方案", "中小企业声明", "投标文件格式"]
FILE_NAME_SKIP = ["第一册", "投标人须知册"]
SECTION_SKIP = [
    "投标人须知", "评分标准", "资格审查", "报价清单", "图纸", "维保方案", "中小企业声明", "投标文件格式", "招标公告", "采购公告", "合同专用条款", "合同通用条款",
]
SECTION_KEEP = ["政府采购合同", "政府采购"]
SECTION_NUMBER = r"第[一二三四五六七八九十\p{Nd}]+[章节篇部分]"
CONTRACT_GLOB = "*.{pdf,doc,docx}"

CONTRACT_WORDS = [
    "甲方", "乙方", "合同", "条款", "签订", "签署", "支付", "付款", "结算", "金额", "费用", "价款", "交付", "验收", "交货", "货物", "标的",
    "违约", "违约金", "赔偿", "责任", "罚款", "发票", "税务", "税率", "增值税", "保密", "知识产权", "争议", "仲裁", "诉讼", "工期", "期限", "日期",
    "届满", "终止", "解除", "质量", "标准", "保证", "担保", "抵押", "采购", "供应", "销售", "承租", "承包", "双方", "约定", "履行", "执行",
    "生效",
]
CONTRACT_MIN_LENGTH = 5

# --- fixed values: rule packs ---------------------------------------------------------------------------------------
# label -> phrases.  "positive" raises the label, "negative" cancels it.

PLACEHOLDER_CHARS = "_…×X"
PLACEHOLDER_SHARE = 0.3

STRICT_SECTIONS = [
    "技术参数", "图纸", "保密条款", "包装", "知识产权", "诉讼管辖", "投标函", "开标一览表", "货物说明一览表", "投标分项报价表", "技术要求", "规格型号", "评标办法",
    "资格审查", "维保方案", "中小企业声明函",
]
STRICT_BUSINESS = [
    "付款", "支付", "汇款", "结算", "开票", "发票", "税费", "进项", "抵税", "验收", "异议", "复检", "检测", "保证金", "质保金", "履约", "违约",
    "赔付", "违约金", "赔偿", "扣款", "罚款", "账户", "对公", "对私", "个人", "现金",
]
STRICT_POSITIVE = {
    1: [
        "财政资金到位", "财政拨款到账", "财政拨付", "财政资金下拨", "按财政资金到位", "待财政拨款", "财政到位", "财政核拨", "尾款无固定", "尾款长期", "尾款无退还期限",
        "长期扣押", "长期扣留", "保证金长期", "保证金至项目结束", "质保金无退还", "质保金无固定", "质保期后无退还", "质保金至", "质保金在项目", "尾款待财政",
        "尾款核拨", "待财政", "验收合格一年后", "验收合格半年后", "质保期满一年", "质保期满半年", "验收合格后半年", "尾款无", "未约定付款时间", "无明确付款",
    ],
    2: [
        "延迟开票", "滞后开票", "交货后开票", "验收后开票", "验收合格后开票", "开票时间晚", "交付后开票", "完工后开票", "税费全由乙方", "乙方承担一切税费",
        "一切税费由乙方", "全部税费由乙方", "税费由供货方承担", "税费由承包方承担", "税费由中标方承担", "发票损失乙方全责", "发票问题乙方自负", "乙方承担发票损失",
        "乙方全额纳税", "乙方承担税费", "税费全部",
    ],
    3: [
        "视为验收", "视为合格", "视为验收通过", "默认合格", "视为验收合格", "直接视为合格", "直接视为验收", "未提异议", "未书面提出视为", "逾期未提视为", "单方验收",
        "单方判定", "单方认定", "甲方单方", "甲方自行", "甲方直接", "异议期3日", "异议期5日", "3日内异议", "5日内异议", "3日内提出异议", "5日内提出异议",
        "3日未提出", "5日未提出",
    ],
    4: [
        "百分之零点五", "按合同总额3‰", "按日百分之", "按延误天数，每延误一天", "每天赔偿", "每日赔偿", "按日赔偿", "甲方不承担违约", "甲方无违约", "甲方不支付违约金",
        "甲方不负责任", "仅乙方承担", "仅罚乙方", "甲方不承担任何责任", "甲方不承担由此", "甲方不负", "甲方免责", "没收履约保证金", "扣除全部货款", "直接扣除",
        "从货款中扣除",
    ],
    5: [
        "私户收款", "个人账户", "汇入个人账户", "转入个人账户", "仅现金结算", "必须现金支付", "现金交易", "现金支付", "禁止对公转账", "不得转账对公", "不可对公转账",
        "法人个人账户", "法定代表人账户", "法人账户", "负责人账户", "打到个人", "汇入个人", "转账至个人", "支付至个人", "汇至个人账户", "转至个人账户", "支付给个人",
    ],
}
STRICT_NEGATIVE = {
    1: [
        "签订合同后", "合同签订后", "合同生效后", "合同签订之日起", "验收合格后", "验收合格之日起", "验收合格且", "验收合格并", "验收合格一年后", "验收合格半年后",
        "验收合格后X日", "验收合格后支付", "货到后", "货到现场", "货物交付后", "安装完成后", "安装调试验收合格后", "质保期满后", "质保期结束后", "质保期满且",
        "质保期满X日", "供货完成后", "交货完成后", "收到发票后", "凭发票付款", "开具发票后", "X个工作日内", "x个工作日内", "个工作日", "工作日内", "X日内",
        "x日内", "日内付清", "日内支付", "日内退还",
    ],
    2: [
        "交货同步开票", "交货同步开专票", "随货同行开具发票", "税费各自承担", "税费各负", "税费依法各自承担", "开具发票后付款", "凭发票付款", "收到发票后付款", "依法纳税",
        "甲方依法纳税", "纳税各自承担", "税费按照国家", "按税法规定", "税费由甲乙双方",
    ],
    3: [
        "异议期7日", "异议期10日", "异议期15日", "异议期30日", "异议期不低于", "异议期不少于", "15日内提出", "30日内提出", "15日内书面", "30日内书面",
        "双方共同核验", "双方共同验收", "双方一起验收", "共同验收", "免费复检", "可申请复检", "共同委托第三方", "第三方机构复检", "复验后仍不合格", "双方确认",
        "书面通知后", "书面提出异议", "书面异议", "验收合格后十五个工作", "验收合格后十个工作", "验收合格后X个工作", "验收合格后五个工作", "验收合格后七个工作",
        "验收合格后支付", "验收合格后付清", "验收合格后办理",
    ],
    4: [
        "甲乙赔付标准一致", "双方违约责任对等", "双方违约对等", "甲方逾期同样赔偿", "甲方延期同样赔付", "甲方承担违约责任", "甲方按日支付违约金", "甲方支付违约金", "双方均",
        "任何一方", "合同双方", "甲方、乙方", "甲方违约", "甲方承担", "违约方承担", "违约责任对等", "投标保证金", "投标保证金将不予", "投标保证金不予",
        "投标保证金将不予返还", "投标保证金将不予退还", "保证金将不予", "保证金不予", "视为放弃中标", "放弃中标", "中标通知书",
    ],
    5: [
        "强制公对公", "必须公对公", "限制公对公", "禁止现金私户", "禁止私户", "严禁个人账户", "必须转账至对公", "必须汇入对公", "必须对公支付", "仅接受对公转账",
        "只接受对公", "必须对公转账",
    ],
}

BASE_SECTIONS = ["技术参数", "图纸", "包装", "知识产权", "诉讼管辖", "保密条款", "投标函", "开标一览表", "货物说明一览表", "投标分项报价表"]
BASE_REPEATED_PLACEHOLDERS = ["________", "……", "XX", "xx", "___", "空白填写"]
BASE_BUSINESS = [
    "付款", "支付", "开票", "发票", "税费", "验收", "异议", "保证金", "质保金", "违约", "赔付", "违约金", "赔偿", "退款", "结算", "对公", "账户",
    "现金",
]
BASE_POSITIVE = {
    1: ["财政资金到位再付", "无固定尾款日期", "长期扣押保证金", "质保金无退还期限", "按财政资金到位情况支付", "待财政拨款后支付", "财政拨款到账后"],
    2: ["交货数月后开票", "税费全由乙方承担", "发票损失乙方全责", "乙方承担全部税费", "开票时间晚于交货", "乙方负责一切税费"],
    3: ["异议期3日", "异议期5日", "3日内异议", "5日内异议", "未提异议直接视为合格", "未书面提出视为合格", "仅甲方单方判定", "视为验收合格"],
    4: ["只约束乙方赔付", "甲方延期无违约金", "瑕疵扣除全款", "乙方逾期扣款", "仅罚乙方", "甲方不承担违约", "乙方向甲方支付违约金"],
    5: ["私户收款", "仅现金结算", "禁止对公转账", "法人个人账户打款", "个人账户", "现金结算", "转入个人账户", "汇款至个人"],
}
BASE_NEGATIVE = {
    1: ["日内付清", "验收合格后", "质保期满", "固定期限退质保金", "X日内付清", "xx日内付清"],
    2: ["交货同步开专票", "税费各自承担", "开具发票后付款"],
    3: ["异议期≥7天", "双方共同核验", "免费复检", "异议期7日", "异议期10日", "异议期15日", "异议期30日"],
    4: ["甲乙赔付标准一致", "甲方逾期同样赔偿", "双方违约责任对等", "甲方延期", "甲方逾期"],
    5: ["强制公对公", "禁止现金私户", "必须转账至对公"],
}

# Keyword tiers: label -> tier -> phrases.
TIERED_KEYWORDS = {
    1: {"high": ["180日", "360日", "顺延", "延期付款", "资金周转困难"], "medium": ["账期", "付款周期", "分阶段支付", "延期"]},
    2: {"high": ["无法开具增值税专票", "回款后开票", "先付款后开票"], "medium": ["发票类型", "开票时间", "开票顺序"]},
    3: {"high": ["满足使用需求后", "无量化验收", "无验收标准"], "medium": ["验收", "验收流程", "验收标准"]},
    4: {"high": ["所有直接间接经济损失", "无限责任", "全额损失兜底"], "medium": ["违约金", "违约责任", "赔偿责任"]},
    5: {"high": ["私人账户结算", "个人账户", "现金大额交易"], "medium": ["关联交易", "付款流程"]},
}
# Order in which equally good labels win.
LABEL_PRIORITY = (5, 1, 2, 3, 4)

ROUTE_ACCEPT = 0.85
ROUTE_REVIEW = 0.6

# --- fixed values: web fetch ----------------------------------------------------------------------------------------

# First domain the host ends with wins.
REFERERS = [
    ("download.ccgp.gov.cn", "https://download.ccgp.gov.cn/"),
    ("ccgp.gov.cn", "https://www.ccgp.gov.cn/"),
    ("222.75.70.90", "https://www.ccgp-ningxia.gov.cn/"),
    ("zbcg.mas.gov.cn", "https://zbcg.mas.gov.cn/"),
    ("ggzyjy.ahsz.gov.cn", "https://ggzyjy.ahsz.gov.cn/"),
    ("60.173.73.4", "http://60.173.73.4/"),
    ("dengzhou.zfcg.henan.gov.cn", "https://dengzhou.zfcg.henan.gov.cn/"),
]
MIME_EXTENSIONS = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
}
MAGIC_EXTENSIONS = [(b"%PDF", ".pdf"), (b"PK\x03\x04", ".docx"), (b"{\\rtf", ".rtf")]
FALLBACK_EXTENSION = ".bin"

# --- our own wording: one generation request per label --------------------------------------------------------------

PROMPTS = {
    0: "请以制造业合同财务审核人员的身份写一条不含财务风险的常规履约条款，20到50字。",
    1: "请以制造业合同财务审核人员的身份写一条付款周期有风险的条款，写明天数或延期条件，20到50字。",
    2: "请以制造业合同财务审核人员的身份写一条开票或税费安排有风险的条款，20到50字。",
    3: "请以制造业合同财务审核人员的身份写一条验收标准或时限不清的条款，20到50字。",
    4: "请以制造业合同财务审核人员的身份写一条违约责任不对等的条款，20到50字。",
    5: "请以制造业合同财务审核人员的身份写一条现金或个人账户结算的条款，20到50字。",
}
SYNTHETIC_BAND = (20, 50)
SYNTHETIC_TARGET = 20000

# --- fixed values: features, model, ranking -------------------------------------------------------------------------

MAX_FEATURES = 5000
MAX_DF = 0.95
FOREST_TREES = 100
FOREST_DEPTH = 30  # deepest tree Spark's forest allows; the depth is otherwise unlimited
FOCAL_GAMMA = 1.0
RANKED_PERCENT = 30.0
TOP_K = 3
