"""Fixed values.

Everything in this module is a value that has to be identical to the
behaviour being reproduced (word lists, rule tables, output strings).  The
lists are kept in their declared order: the first match in declaration order
wins wherever a rule stops at the first hit.
"""

# ---------------------------------------------------------------- fixed values
# URL shortener services (rule: substring of the host, +3).
SHORTENERS = [
    "bit.ly", "t.cn", "tinyurl.com", "ow.ly", "is.gd", "buff.ly",
    "goo.gl", "short.url", "rb.gy", "cutt.ly", "rebrand.ly",
    "shorte.st", "bc.vc", "v.gd", "x.co", "lc.chat",
]

# Suspicious top-level domains (rule: host ends with, +2).
SUSPICIOUS_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".work", ".date"]

# Commonly impersonated brands (rule: first brand contained in the host).
BRANDS = [
    "apple", "google", "microsoft", "amazon", "paypal", "facebook",
    "netflix", "instagram", "twitter", "linkedin", "dropbox",
    "alibaba", "taobao", "wechat", "微信", "qq", "alipay",
    "支付宝", "jd", "京东", "baidu", "携程", "顺丰", "sf-express",
    "icbc", "中国银行", "ccb", "招商银行", "农业银行", "建设银行",
]

# Phishing terms (rule: first term contained in the host, +1).
PHISH_TERMS = [
    "verify", "secure", "login", "signin", "account", "update",
    "password", "banking", "confirm", "safety", "security",
    "验证", "登录", "安全", "账号", "账户", "密码", "确认", "银行",
]

# Ports that do not count as abnormal.
ALLOWED_PORTS = [80, 443, 8080, 8443]

# Keyword lexicons for the keyword-density feature.
LEXICON_FULL35 = [
    "验证", "账号", "账户", "安全", "登录", "点击", "链接", "银行",
    "冻结", "停用", "更新", "确认", "密码", "身份", "验证码",
    "退款", "中奖", "补贴", "奖金", "领取", "福利", "优惠",
    "紧急", "立即", "尽快", "否则", "关闭", "异常", "风险",
    "客服", "通知", "系统", "升级", "激活", "认证",
]
LEXICON_SHORT9 = ["验证", "账号", "银行", "冻结", "中奖", "补贴", "点击", "链接", "密码"]

# Rule reason texts; "{}" is the interpolated value.
REASON_HTTP = "HTTP 非加密"
REASON_IP = "IP 直连"
REASON_SHORTENER = "短网址服务 ({})"
REASON_TLD = "可疑顶级域 ({})"
REASON_BRAND_HYPHEN = "疑似仿冒 {}（含连字符）"
REASON_BRAND_UNOFFICIAL = "疑似仿冒 {}（非官方域名）"
REASON_HYPHENS = "域名连字符过多 ({}个)"
REASON_TERM = "域名含敏感词 ({})"
REASON_DEPTH = "子域名层级过深 ({}级)"
REASON_AT = "URL 含 @ 符号（重定向攻击）"
REASON_PORT = "异常端口 ({})"

# URL report layout.
LEVEL_ICONS = {"safe": "✅", "low": "🟢", "medium": "🟠", "high": "🔴"}
REPORT_REASON_PREFIX = "   └ "
REPORT_NO_LINKS = "未提取到链接"
URL_REPORT_WIDTH = 80

# Verdicts.
VERDICT_PHISHING = "【高风险】钓鱼邮件"
VERDICT_SAFE = "【安全】正常邮件"
BAND_SAFE = ("✅ 安全：正常邮件", "无风险")
BAND_MEDIUM = ("🟠 中危：风险钓鱼邮件", "中危")
BAND_HIGH = ("🛑 高危：极高风险钓鱼邮件", "高危")

# Scoring modes and engine display names -> scoring mode.
MODES = ("RF", "BERT", "ENSEMBLE")
MODE_NAMES = {"机器学习引擎": "RF", "深度学习引擎": "BERT", "加权集成检测": "ENSEMBLE"}

# Score fusion and URL boost.
DEFAULT_RF_WEIGHT = 0.4
DEFAULT_SECOND_WEIGHT = 0.6
BOOST_HIGH_RISK = 6
BOOST_HIGH = 0.15
BOOST_MEDIUM_RISK = 4
BOOST_MEDIUM = 0.08

# Defaults of the mail table.
UNKNOWN = "Unknown"
EMPTY_BODY = "Empty_Body"
REPLY_TO_DEFAULT = "None"

# The nine numeric features, in their fixed order (perplexity last).
FEATURES = [
    "sentiment", "subjectivity", "avg_url_len", "avg_url_dots",
    "has_at_symbol", "has_ip_url", "avg_subdomains", "url_count", "perplexity",
]
FEATURES_NO_PPL = FEATURES[:-1]

# Text limits.
PERPLEXITY_PREFIX = 256  # optional window (the original scorer input), not used by default
DECONTAMINATION_PREFIX = 100
PART_TEXT_LIMIT = 3000
VOCAB_SIZE = 500
# ------------------------------------------------------------ end fixed values
