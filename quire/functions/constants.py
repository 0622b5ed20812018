"""Word lists, patterns and thresholds that decide results. They are data, kept together and in natural order."""

# File extensions of page images, by use.
PAGE_IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")

# Junk words in names and contents of markup files.
JUNK_COMMON = ("createby", "createinfo", "endinfo", "theendinfo", "mox", "kox", "wnacg", "18comic", "manhuagui")
JUNK_NAMES = (*JUNK_COMMON, "powered", "dmzj", "mhx12")
JUNK_CONTENTS = (*JUNK_COMMON, "mox.moe", "koz", "mhx12.com", "最新地址", "最新域名", "收藏本站", "加入书签", "在线阅读", "版权归原作者所有")
JUNK_TAIL = ("mox", "kox", "18comic", "wnacg", "manhuagui", "koz", "最新地址", "最新域名", "收藏本站", "加入书签", "在线阅读", "在線閱讀", "版权归原作者所有", "版權歸原作者所有")

# Names of cover pages, and of pages that stay as they are.
COVER_NAMES = ("cover", "封面", "frontcover", "backcover")
PROTECTED_NAMES = ("end", "ad", "ads", "adv", "advertisement", "copyright", "backcover", "afterword")

# Labels of special volumes, in order of precedence.
SPECIALS = (
    "原画集", "原畫集", "頁集", "设定集", "設定集", "公式书", "公式書", "短篇集", "画集", "畫集", "画册", "畫冊", "插画集", "插畫集",
    "黑板报", "黑板報", "after10days", "番外", "外传", "外傳", "特典", "附录", "附錄", "短篇", "特別篇", "特别篇", "特刊", "秘笈", "秘籍",
    "内幕集锦", "內幕集錦", "人物特写", "人物特寫", "秘密章节", "秘密章節", "元素分析", "名言集", "纪念", "紀念",
)

# Volume patterns in order of precedence, in Java syntax; group 1 is the number.
VOLUMES = (
    r"第\s*(\d+(?:[.．]\d+)?)\s*[卷期]",
    r"[卷期][_\-\s]*(\d+(?:[.．]\d+)?)",
    r"(\d{1,4}(?:[.．]\d+)?)\s*期",
    r"^\s*(\d{1,4}(?:[.．]\d+)?)(?=\D)",
    r"\bv(?:ol)?[_\-\s]*(\d+(?:[.．]\d+)?)\b",
    r"(\d+(?:[.．]\d+)?)$",
)
INFERRED_VOLUMES = (
    r"第\s*0*(\d+(?:\.\d+)?)\s*[卷冊册]",
    r"[卷期]\s*0*(\d+(?:\.\d+)?)",
    r"vol(?:ume)?\.?\s*0*(\d+(?:\.\d+)?)",
    r"[_\-\s]0*(\d{1,3}(?:\.\d+)?)(?=\D*$)",
)
ANNIVERSARY = r"^\s*(?:週年|周年)"
REGIONAL_EDITION = r"\s*[（(]\s*(?:台版|臺版|台湾版|台灣版|日版|日本版|港版|香港版|陸版|陆版|大陸版|大陆版|繁中版|繁體中文版|简中版|簡中版)\s*[）)]\s*$"
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９．", "0123456789."
CHINESE_MONTHS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二")

# Genre vocabulary, in order: (name, pattern).
GENRES = (
    ("Action", "(?:動作|动作|戰鬥|战斗|格鬥|格斗|武俠|武侠|action)"),
    ("Adventure", "(?:冒險|冒险|adventure)"),
    ("Fantasy", "(?:奇幻|魔幻|魔法|fantasy)"),
    ("Science fiction", "(?:科幻|科學幻想|科学幻想|science[ -]?fiction|sci-fi)"),
    ("Mystery", "(?:推理|懸疑|悬疑|偵探|侦探|mystery|detective)"),
    ("Thriller", "(?:驚悚|惊悚|thriller)"),
    ("Horror", "(?:恐怖|獵奇|猎奇|horror)"),
    ("Romance", "(?:戀愛|恋爱|愛情|爱情|浪漫|romance)"),
    ("Comedy", "(?:喜劇|喜剧|搞笑|幽默|comedy)"),
    ("Drama", "(?:劇情|剧情|戲劇|戏剧|drama)"),
    ("Historical", "(?:歷史|历史|(?:時代|时代)(?:劇|剧|背景)|historical)"),
    ("Sports", "(?:體育|体育|運動|运动|競技|竞技|sports?)"),
    ("Slice of life", "(?:日常|生活片段|slice of life)"),
    ("Supernatural", "(?:超自然|靈異|灵异|神怪|妖怪|supernatural)"),
    ("Mecha", "(?:機甲|机甲|機器人|机器人|mecha)"),
)

# Categories that maintain an encyclopedia and say nothing about a work.
MAINTENANCE_CATEGORIES = (
    "^CS1", "^(?:引文|引用)格式", "(?:錯誤|错误)", "^含有.*(?:條目|条目|文本)", "(?:需訂閱|需订阅).*(?:頁面|页面)", "(?:條目|条目|頁面|页面)$",
    "(?:維基|维基|Wikidata|维基数据|維基數據)", "(?:用戶名|用户名)",
)

# Regions that are named before a publisher, and arrows between one and its successor.
REGIONS = (
    "臺灣", "台灣", "台湾", "日本", "香港", "中國大陸", "中国大陆", "中國", "中国", "新加坡", "韓國", "韩国", "美國", "美国", "加拿大", "法國", "法国", "德國", "德国", "義大利", "意大利", "西班牙",
    "馬來西亞", "马来西亚",
)
SUCCESSION = "→|⇒|➜|➝|⟶"

# Thresholds of page images.
GARBAGE_BYTES, GARBAGE_BYTES_SMALL = 140 * 1024, 60 * 1024
SPARSE_FOREGROUND, LEAST_SPAN, CROP_PADDING = 0.37, 0.82, 12
RENDER_SAMPLE, RENDER_LOW, RENDER_HIGH, RENDER_DEFAULT = 24, 1200, 4000, 3500
FALLBACK_SPINE = 9999
CACHE_VERSION = 7

# Text recognition of front pages: least confidence of a line, titles and categories of disclaimers, titles and phrases of age warnings, in order.
LEAST_CONFIDENCE = 0.55
DISCLAIMER_TITLES = ("免责声明", "免責聲明", "免责申明", "免責申明")
DISCLAIMER_CATEGORIES = {
    "copyright": ("版权归", "版權歸", "作者所有", "出版社及作者"),
    "noncommercial": ("非盈利", "非赢利", "非營利", "商业盈利", "商業盈利", "商业目的", "商業目的"),
    "download": ("下载资源", "下載資源", "下载后24小时", "下載後24小時", "24小时内删除", "24小時內刪除"),
    "liability": ("法律责任", "法律責任", "后果自负", "後果自負", "不承担", "不承擔"),
    "learning": ("交流学习", "交流學習", "学习之用", "學習之用", "阅读学习", "閱讀學習"),
    "piracy": ("盗版", "盜版", "购买正版", "購買正版", "请购买正版", "請購買正版"),
    "infringement": ("权利造成了侵犯", "權利造成了侵犯", "侵权", "侵權", "撤销相关内容", "撤銷相關內容"),
}
WARNING_TITLES = ("警告", "WARNING")
RESTRICTIONS = ("年龄未满18岁", "年齡未滿18歲", "未满18岁", "未滿18歲", "未满十八岁", "未滿十八歲", "UNDER THE AGE OF 18", "UNDER 18")
