"""Tables and patterns that results depend on."""

# tracking parameters by beginning and by name
TRACKING_PREFIXES = ("utm_", "spm_", "_hs", "mc_", "pk_", "at_", "ga_")
TRACKING_EXACT = (
    "spm", "from", "from_source", "from_spmid", "share_token", "share_source", "share_medium", "share_plat", "share_tag",
    "share_session_id", "shareurl", "timestamp", "unique_k", "vd_source", "buvid", "up_id", "seid", "fbclid", "gclid", "yclid",
    "msclkid", "igshid", "ref", "ref_src", "referer", "referrer", "s", "src", "source", "scene", "sessionid", "chksm", "srcid",
    "sharer_sharetime", "sharer_shareid", "exportkey", "device_id", "traceid", "trace_id", "logid", "log_id", "click_id",
    "app_platform", "app_version", "channel", "tt_from", "u_code",
)
# hosts where only these parameters matter
ESSENTIAL_PARAMS = {"mp.weixin.qq.com": ("__biz", "mid", "idx", "sn"), "www.bilibili.com": ("p", "t"), "www.youtube.com": ("v", "list"), "www.zhihu.com": ()}
# other names of a host
HOSTS = {"m.weibo.cn": "weibo.com", "www.weibo.com": "weibo.com", "m.zhihu.com": "www.zhihu.com", "zhihu.com": "www.zhihu.com", "m.bilibili.com": "www.bilibili.com", "bilibili.com": "www.bilibili.com"}
TITLE_NOISE = "[\\s　]+|[「」『』【】\\[\\]()《》<>“”\"'’‘·・,。.!?\\\\:;、~\\-—_|｜#]+"
BLANK = r"(?U)^\s*$"
# domains of items
SOURCES = ("weibo", "zhihu", "bilibili", "douyin", "xiaohongshu", "wechat_mp", "toutiao", "thepaper", "news", "finance", "rss", "other")
KINDS = ("hotlist", "article", "post", "video", "quote")
# what in a link tells its source, in this order; the last two are matched as they are written
SOURCE_GUESSES = (("zhihu", ("zhihu.com", "/zhihu/")), ("wechat_mp", ("mp.weixin.qq.com", "wechat_mp")), ("finance", ("dj.com", "wsj.com", "wallstreetcn", "finance")), ("bilibili", ("bangumi",)))
WECHAT_FEED = "MP_WXS_"
CATEGORIES = {"zhihu": "zhihu", "wechat_mp": "wechat", "finance": "finance"}
# the daily digest: how it's known, what it's called in print, its entries, what its catalog leaves out
DAILY_COLLECTOR, DAILY_TITLE, DAILY_NAME = "知乎日报", "早报", "今日知乎日报"
DAILY_ENTRY, DAILY_END, DAILY_BACKGROUND = r"\d+[、.]\s*(.+?[？?])", "小李精选", "背景"
# lines from which a text is only boilerplate: beginnings, and a part
BOILERPLATE_BEGINS, BOILERPLATE_HAS = ("风险提示", "以上精彩内容来自"), "年度会员"
# hosts whose articles come with photos
PHOTO_HOSTS = r"mp\.weixin\.qq\.com/s|wallstreetcn\.com/articles|wallstreetcn\.com/livenews|zhuanlan\.zhihu\.com/p/|zhihu\.com/p/|/answer/"
# words of navigation; what marks an image, and what its class, as decoration
NAVIGATION = "登录|注册|首页|下载APP|相关推荐|热门评论|版权所有|ICP备|隐私政策|关于我们|导航|分享到|点击查看|打开APP"
DECORATION = r"(?i)avatar|emoji|qrcode|qr[_-]?code|icon|logo|badge|spacer|pixel|1x1|placeholder|tracking|mmhead|user[-_]head|profile_avatar|wx_fmt=gif|formula|equation|latex|/s50|/s64|_s\.jpg|_is\.jpg|share_card|js_next_card"
DECORATION_CLASS = r"(?i)avatar|emoji|qrcode|icon|logo|badge|equation|formula|ProfileHeader|AuthorInfo|UserLink|share"
# kinds and sources of personal ranking
RANK_KINDS, BOARD_SOURCES = ("article", "post"), ("toutiao", "douyin", "weibo", "thepaper", "bilibili")
# limits and priorities of sections
SECTION_LIMITS = {"lede": 1, "headline": 6, "deepread": 8, "oral": 2, "critical": 3, "subscribe": 6, "hotlist": 1, "health": 0}
SECTION_ORDER = ("lede", "headline", "deepread", "oral", "critical", "subscribe", "hotlist", "health")
SECTION_PRIORITY = {"headline": 0.97, "lede": 0.88, "deepread": 0.86, "oral": 0.80, "critical": 0.72, "subscribe": 0.60, "hotlist": 0.28, "health": 0.18}
# weights of the parts of a score
WEIGHTS = {
    "default": {"sim": 0.30, "len": 0.10, "llm": 0.30, "hot": 0.15, "kw": 0.15, "dup": 0.20, "half_life": 12.0},
    "am": {"sim": 0.28, "len": 0.10, "llm": 0.28, "hot": 0.12, "kw": 0.22, "dup": 0.20, "half_life": 8.0},
    "pm": {"sim": 0.35, "len": 0.15, "llm": 0.35, "hot": 0.05, "kw": 0.10, "dup": 0.20, "half_life": 24.0},
}
# words that the critic's rubric looks for
CRITIC_HIGH = ("然而", "但是", "未必", "假设", "前提", "边界", "相反", "另一种", "并不意味着", "值得怀疑", "因果", "混淆", "可检验", "不确定")
CRITIC_LOW = ("震惊", "速看", "必看", "家人们", "转发收藏", "不转不是", "性价比之王", "抓紧入手", "日入", "割韭菜", "涨停板", "内幕")
CRITIC_NEWS = ("据悉", "消息称", "最新进展", "官方通报", "发布会")
CRITIC_DATA = r"\d+(\.\d+)?%?|同比|环比|样本|实验|文献|论文"
# verdicts of the critic
CRITIC_SAYS = ("有反例/前提/边界,启发式加分", "命中低分特征", "中性资讯")
CRITIC_ANGLES = ("触及:", "像营销或标题党", "未检测出明确假设挑战")
# sentences of the printed sections
LEDE_LABELS, LEDE_MORE, LEDE_EMPTY = {"am": "今晨", "pm": "今日"}, "内页还有", ("本期", "稿件不足,请先看体检页,再决定要不要当它是一份报。")
EDITION_NAMES = {"am": "早报", "pm": "晚报"}
SECTION_TITLES = {"headline": "头版", "deepread": "深度阅读", "critical": "今日一问", "subscribe": "订阅更新", "oral": "口播", "hotlist": "今日新上榜 Top 20", "health": "系统体检"}
SECTION_INTROS = {"headline": "今日打分最高的几条,不是热度最高的几条。", "deepread": "更像收藏夹里那种长度和口味的长文。", "critical": "批判性思考分最高的内容。允许它和你的口味不太像。"}
SECTION_EMPTY = {"headline": "_本栏目今日无入选。_", "deepread": "_本栏目今日无入选。_", "critical": "_本栏目今日无入选。_", "oral": "_今日口播未成。_"}
PRINT_LINK, PRINT_VIDEO, PRINT_NO_BODY, PRINT_RELATED = "原文地址(需上网)", "_视频暂不转写。_", "_没有正文,只保留标题。_", "**相关报道(已折叠):** "
ITEM_LINK, ITEM_VIDEO, ITEM_NO_BODY, ITEM_NO_DATE = "原文地址(需上网,纸上看不到点)", "_视频暂不转写，只保留标题和链接。_", "_库里没有正文。热榜/视频常如此;文章则多半是抽取失败。_", "时间未知"
HEALTH_GOOD, HEALTH_BAD = "**全部正常。** 已配置的采集器在 24h 内有成功记录,产出无明显骤降。", ("**告警 ", " 项** —— 读报时请扫一眼。")
ORAL_INTRO = "合集按天滴灌，订阅 UP 新片转写后见报。不进头版打分。"
DIGEST_TITLE, DIGEST_ISSUE, DIGEST_MADE, DIGEST_PARTS, DIGEST_FAILED, DIGEST_GAPS = "自动日报", "期号", "生成于", "版面", "失败", "**本期残缺。** 失败版面:"
