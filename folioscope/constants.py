"""Results depend on these exact values, so they are stated as plain text."""

# --- stored model -----------------------------------------------------------
EXTRACTION_STATUSES = ("pending", "success", "partial", "failed")
RETENTION_MINUTES = 10
MAX_TAG_NAME = 30
MAX_TAGS_PER_BOOKMARK = 12
MAX_TITLE = 300
MAX_NOTE = 5_000
MAX_MARKDOWN = 2 * 1024 * 1024
MAX_URL = 4_000
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 100

# --- error codes and their display text -------------------------------------
ERROR_MESSAGES = {
    "INVALID_URL": "网址格式不正确",
    "UNSUPPORTED_PROTOCOL": "只支持 HTTP 和 HTTPS 网址",
    "DUPLICATE_URL": "该网址已经收藏",
    "PRIVATE_NETWORK_BLOCKED": "出于安全原因，不能访问本地或内网地址",
    "DNS_FAILED": "无法解析该网址的域名",
    "REQUEST_TIMEOUT": "请求网页超时",
    "TOO_MANY_REDIRECTS": "网页重定向次数过多",
    "HTTP_FORBIDDEN": "目标网站拒绝访问",
    "HTTP_NOT_FOUND": "网页不存在",
    "HTTP_SERVER_ERROR": "目标网站暂时不可用",
    "CONTENT_TOO_LARGE": "网页内容超过系统限制",
    "UNSUPPORTED_CONTENT_TYPE": "该地址不是可提取的网页",
    "EMPTY_RESPONSE": "网页返回内容为空",
    "CONTENT_TOO_SHORT": "未识别到足够的正文内容",
    "JS_REQUIRED": "网页可能需要 JavaScript 或登录后访问",
    "PARSE_FAILED": "网页正文解析失败",
    "VALIDATION_ERROR": "提交内容不符合要求",
    "NOT_FOUND": "未找到对应记录",
    "CONTENT_EDITED": "正文已被手动编辑，重新提取前需要确认覆盖",
    "UNKNOWN_ERROR": "服务暂时不可用，请稍后重试",
}
DEFAULT_FAILURE_TEXT = "无法提取网页正文"
SHORT_CONTENT_TEXT = "正文已保存，但内容较短，建议检查或手动编辑"
NO_MAIN_BLOCK_TEXT = "未识别到可阅读的正文内容"
PENDING_SUMMARY = "正在提取正文…"
EMPTY_SUMMARY = "尚未提取到正文，可打开详情查看原因并手动补充内容。"

# --- network safety -----------------------------------------------------------
BLOCKED_HOSTS = (
    "localhost",
    "localhost.localdomain",
    "instance-data",
    "metadata",
    "metadata.google.internal",
    "metadata.azure.internal",
)
BLOCKED_HOST_SUFFIXES = (".localhost", ".local", ".internal")
BLOCKED_IPV4 = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
)
BLOCKED_IPV6 = (
    ("::", 128),
    ("::1", 128),
    ("::ffff:0:0", 96),
    ("64:ff9b::", 96),
    ("100::", 64),
    ("2001:2::", 48),
    ("2001:10::", 28),
    ("2001:db8::", 32),
    ("fc00::", 7),
    ("fe80::", 10),
    ("ff00::", 8),
)
FAKE_IPV4 = ("198.18.0.0", 15)

# --- fetching -----------------------------------------------------------------
MAX_BODY_BYTES = 5 * 1024 * 1024
MAX_REDIRECTS = 5
HTML_CONTENT_TYPES = ("text/html", "application/xhtml+xml")
IMAGE_CONTENT_TYPES = (
    "image/png",
    "image/jpeg",
    "image/gif",
    "image/webp",
    "image/avif",
    "image/svg+xml",
)
ALTERNATE_CLIENT_STATUSES = (401, 403, 429, 503)
RETRYABLE_IMAGE_CODES = (
    "REQUEST_TIMEOUT",
    "HTTP_FORBIDDEN",
    "HTTP_SERVER_ERROR",
    "UNKNOWN_ERROR",
)
RETRYABLE_CLIENT_CODES = (
    "DNS_FAILED",
    "EMPTY_RESPONSE",
    "HTTP_SERVER_ERROR",
    "NETWORK_ERROR",
    "REQUEST_TIMEOUT",
    "UNKNOWN_ERROR",
)

# --- text patterns (Java regular expressions) -----------------------------------
CJK_QUALITY = r"[\u3400-\u9fff]"
CJK_READING = r"[\u4e00-\u9fa5]"
ENGLISH_WORD = r"[A-Za-z]+(?:['’-][A-Za-z]+)*"
LOGIN_WORDS = r"(?i)登录|登入|sign\s*in|log\s*in|验证码|captcha"
PLAIN_MARKS = r"[#>*_`~\[\]()!-]"
PLAIN_MARKS_WITH_PIPE = r"[#>*_`~\[\]()|!-]"
UNSAFE_FILENAME = r'[<>:"/\\|?*\x00-\x1f]'

# --- pagination -----------------------------------------------------------------
PAGING_KEYS = ("page", "p", "paged", "pageindex", "pageno", "pagenumber")
MAX_SERIES_PAGES = 10
NEXT_TEXT = r"(?i)^(?:next|next page|下一页|下页|后一页|›|»|→)$"
NEXT_BLOCK = r"(?i)下一页|下页|后一页|next"
PATH_MARKER_BEFORE_EXTENSION = r"_(\d+)(\.[^./]+)$"
PATH_MARKER_WORD = r"(?i)[-_/](?:page|p)[-_/]?(\d+)/?$"
PATH_MARKER_NUMBER = r"/(\d+)/?$"

# --- images ---------------------------------------------------------------------
IMAGE_PATH = r"(?i)\.(?:avif|gif|jpe?g|png|webp)$"
PLACEHOLDER_PATH = (
    r"(?i)(?:^|[-_/])(blank|empty|loading|placeholder|spacer|transparent|pixel)"
    r"(?:[-_. /]|$)"
)
LAZY_IMAGE_ATTRIBUTES = (
    "data-original",
    "data-original-src",
    "data-lazy-src",
    "data-actualsrc",
    "data-src",
    "data-url",
    "data-lazy",
)
IMAGE_VIEWER_PATH = r"(?i)(?:show|view).*(?:image|pic)|(?:image|pic).*(?:show|view)"
BACKGROUND_IMAGE = r"""(?i)background(?:-image)?\s*:[^;]*url\(\s*(["']?)(.*?)\1\s*\)"""
DEFAULT_BACKGROUND_ALT = "文章背景图片"
DEFAULT_IMAGE_ALT = "文章图片 "
ASSET_FILENAME = r"^[a-f0-9]{24}\.(?:png|jpg|gif|webp|avif|svg)$"
BOOKMARK_ID = r"^[A-Za-z0-9_-]{1,128}$"
ASSET_URL = (
    r"/api/bookmarks/[A-Za-z0-9_-]+/assets/[a-f0-9]{24}\.(?:png|jpg|gif|webp|avif|svg)"
)
ASSET_CONTENT_TYPES = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "avif": "image/avif",
    "svg": "image/svg+xml",
}
MAX_IMAGES = 60
MAX_IMAGE_TOTAL_BYTES = 50 * 1024 * 1024

# --- page clean-up ----------------------------------------------------------------
FORBIDDEN_TAGS = (
    "script",
    "style",
    "iframe",
    "object",
    "embed",
    "form",
    "input",
    "button",
    "video",
    "audio",
)
BOILERPLATE_TAGS = ("nav", "aside", "header", "footer")

# --- embedded charts ----------------------------------------------------------------
CHART_SCHEMA_MARKER = "https://vega.github.io/schema/vega-lite"
MAX_CHARTS = 12
CHART_THEME_WINDOW = 8_000  # characters before a chart that may name its theme
SUMMARY_CHARACTERS = 160
FILENAME_CHARACTERS = 80
LOGIN_WORDS_WITHIN = 1200  # first characters in which words of a login page count
IMAGE_HEAD_BYTES = 256  # first bytes in which an SVG must begin
CHARSET_HEAD_BYTES = 1024  # first bytes in which a <meta> may name the character set
CHART_THEME = r'(?i)\\?"theme\\?"\s*:\s*\\?"(blue|yellow|orange|green|pink|gray)\\?"'
CHART_DEFAULT_THEME = "blue"
CHART_PLACEHOLDER = "BOOKMARK-DYNAMIC-CHART"
CHART_VISUAL_KEYS = (
    "mark",
    "layer",
    "hconcat",
    "vconcat",
    "concat",
    "facet",
    "repeat",
    "spec",
)
CHART_SLOT_MIN_HEIGHT = 150
CHART_DEFAULT_TITLE = "图表 "
CHART_SECTION_CJK = "## 图表"
CHART_SECTION = "## Charts"
