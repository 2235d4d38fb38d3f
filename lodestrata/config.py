"""The domain profile: scope, vocabularies and the scoring rubric. Operators take a profile; ``SHANGHAI_PM`` is the default."""

from __future__ import annotations

from dataclasses import dataclass, field

UNKNOWN = "unknown"

# --- fixed values of the record contract ---------------------------------------------------------
RECOMMENDATIONS = ("优先推荐", "可以考虑", "谨慎评估", "不推荐", "信息不足")
TOP, CONSIDER, CAUTION, REJECT, INSUFFICIENT = RECOMMENDATIONS
HIGH = (TOP, CONSIDER)
#: Fixed patterns of captured texts: how a numbered item begins, signs of the person to contact, usual misreadings, pay.
ITEM_PATTERN = r"(?:\d{1,2}[、.)]|[一二三四五六七八九十]+、)"
CONTACT_PATTERN = r"(?i)(?:[\x{4e00}-\x{9fa5}]{1,4}(?:女士|先生)\s*[vV]|招聘(?:专家|HR|专员|顾问)|HRBP?\b|[vV]\s*[•·]\s*(?:在线|今日活跃|刚刚活跃))"
MISREADINGS = ((r"(?<!\w)020(?!\w)", "O2O"), (r"(?<!\w)Al(?!\w)", "AI"), (r"\s+([，。；：、！？）】》])", "$1"), (r"([（【《])\s+", "$1"))
SALARY = r"(?:\d+(?:\.\d+)?-\d+(?:\.\d+)?K(?:·\d+薪)?|\d+-\d+元/(?:时|天))"
SALARY_K = r"\d+(?:\.\d+)?-\d+(?:\.\d+)?K(?:·\d+薪)?"
PAGE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
PIPELINES = ("public_index", "ocr_jd")
VERIFICATIONS = ("unverified_index_snapshot", "captured_jd", "needs_review")
COMPLETE_CAPTURES = ("captured", "detail_captured", "list_detail_captured")
USER_STATUSES = ("未看", "候选", "已投递", "不合适", "待复核")
SCALARS = (
    "id", "url", "title", "company", "city", "district", "office_location", "salary", "workExperience", "education",
    "company_size", "financing_stage", "industry", "recruiter_type", "description", "job_description_raw",
    "responsibilities", "requirements", "pipeline", "verification_status", "capture_status", "scoring_config_version",
)
ARRAYS = ("tags", "directions", "missing_information", "review_reasons", "score_components", "hard_filter_reasons")
INCOMPLETE_JD = "完整JD或职责证据"
VERIFICATION_LABELS = {"captured_jd": "完整 JD", "needs_review": "待复核", "unverified_index_snapshot": "公开索引待验证"}
NOT_KNOWN, NO_TEXT = "未知", "JD 待补充"
#: What an imported record must have as text, may have as text, and must have as a list of texts.
IMPORT_TEXTS = ("id", "url", "title", "city", "recommendation", "pipeline", "verification_status")
IMPORT_OPTIONAL = tuple(f for f in SCALARS if f not in IMPORT_TEXTS) + ("recruiter_name", "recruiter_role", "recruiter_activity", "collected_at", "job_status")
IMPORT_LISTS = ("missing_information", "review_reasons")
IMPORT_OPTIONAL_LISTS = ("tags", "directions", "hard_filter_reasons", "positive_evidence")
#: What the index leaves open, and words that classify a record's text, by scorer.
MISSING = ("岗位当前开放状态", "完整JD", "公司信息", "办公地点", "发布时间", "招聘者信息")
C_WORDS, B_WORDS = ("C端", "用户端", "App", "小程序"), ("B端", "企业SaaS", "商家后台", "内部系统")
C_WORDS_JS, B_WORDS_JS, CORE_JS = (*C_WORDS, "消费者"), (*B_WORDS, "中后台"), ("核心链路", "交易链路")
FORMS_OUT_PY, LAYERS_PY, LAYERS_OUT_PY = ("企业SaaS", "ERP", "CRM", "MES"), ("用户层", "核心链路", "交易链路"), ("纯内部系统", "开发者平台", "数据基础设施")
SEVERE_PY = "严重真实性风险"
EXCLUDED_OCR, ADJACENT_OCR = ("商业化广告", "支付产品", "金融产品", "数据治理", "医疗信息化"), "AI应用"
#: Lines that are never a company, and words of recruiters.
NOT_COMPANIES = ("C端产品", "B端产品", "产品", "AI产品", "电商产品")
AGENT_WORD, AGENT_TYPE, STAFF_TYPE = "猎头", "猎头", "HR"
STAFF_PATTERN = "(?i)招聘专家|招聘专员|招聘顾问|HR|人事专员|人力资源专员"
# -------------------------------------------------------------------------------------------------


def _points(**values: int | None) -> dict[str, int | None]:
    """Factors in hundredths, with the unknown class."""
    return {**values, UNKNOWN: None}


@dataclass(frozen=True)
class Profile:
    """Everything that is about the domain and not about the engine. Factors are hundredths, so sums stay integers."""

    # fixed values of the domain
    city: str = "上海"
    role: str = "产品经理"
    host: str = "zhipin.com"
    version: str = "matching-v2.1.0"
    preferences_version: str = "shanghai-pm-preferences-v1.0.0"
    taxonomy_version: str = "product-directions-v2.0.0"
    weights: dict[str, int] = field(default_factory=lambda: {
        "title_fit": 4, "city_fit": 4, "direction_fit": 14, "product_form_fit": 9, "product_layer_fit": 9, "financing_fit": 3,
        "responsibility_fit": 20, "role_fit": 7, "experience_fit": 6, "company_quality": 6, "freshness_fit": 3,
        "mandatory_requirement_fit": 3, "team_quality": 4, "work_mode_fit": 3, "growth_value": 4, "risk_fit": 1,
    })
    non_blocking: tuple[str, ...] = ("financing_fit", "company_quality", "freshness_fit", "team_quality")
    factors: dict[str, dict[str, int | None]] = field(default_factory=lambda: {
        "title_fit": _points(preferred=100, conditional=65, excluded=0),
        "city_fit": _points(match=100, conditional=60, mismatch=0),
        "direction_fit": _points(priority=100, adjacent=72, excluded=0),
        "product_form_fit": _points(priority=100, conditional=65, excluded=0),
        "product_layer_fit": _points(priority=100, conditional=65, excluded=0),
        "financing_fit": _points(preferred=100, normal=80, conditional=60, review=45),
        "responsibility_fit": _points(high=100, medium=68, low=30, excluded=0),
        "role_fit": _points(preferred=100, conditional=65, excluded=0),
        "experience_fit": _points(high=100, medium=72, low=35),
        "company_quality": _points(high=100, medium=70, low=30),
        "freshness_fit": _points(high=100, medium=70, low=30),
        "mandatory_requirement_fit": _points(match=100, conditional=60, unmet=0),
        "team_quality": _points(high=100, medium=70, low=30),
        "work_mode_fit": _points(match=100, conditional=60, mismatch=0),
        "growth_value": _points(high=100, medium=68, low=30),
        "risk_fit": _points(clear=100, light=80, medium=50, severe=0),
    })
    preferred_at: int = 94
    consider_at: int = 80
    review_at: int = 65
    floor_permille: int = 700
    incomplete_percent: int = 55
    hard_filters: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "job_status": ("closed",), "title_fit": ("excluded",), "city_fit": ("mismatch",), "direction_fit": ("excluded",),
        "product_form_fit": ("excluded",), "product_layer_fit": ("excluded",), "responsibility_fit": ("excluded",),
        "role_fit": ("excluded",), "mandatory_requirement_fit": ("unmet",), "work_mode_fit": ("mismatch",), "risk_fit": ("severe",),
    })
    priority: tuple[str, ...] = ("用户产品", "用户增长", "本地生活", "LBS", "出行", "交易", "履约")
    adjacent: tuple[str, ...] = ("AI应用", "电商平台", "C端策略平台", "海外C端")
    excluded: tuple[str, ...] = ("商业化广告", "支付金融", "企业SaaS", "数据平台", "政务信息化", "硬件工业")
    duties: tuple[tuple[str, ...], ...] = (
        ("用户研究", "需求洞察", "行为分析"),
        ("产品规划", "方案设计", "版本迭代"),
        ("增长", "转化", "留存", "召回"),
        ("交易", "订单", "履约", "售后"),
        ("指标", "数据分析", "A/B"),
    )
    delivery: tuple[str, ...] = ("上线", "落地", "迭代", "验证")
    index_tags: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("用户增长", ("用户增长", "增长产品")), ("用户产品", ("用户产品", "C端", "C 端")), ("交易", ("交易", "订单")),
        ("履约", ("履约", "售后")), ("本地生活", ("本地生活",)), ("LBS", ("LBS", "地图")), ("出行", ("出行",)),
        ("策略", ("策略产品",)), ("AI应用", ("AI应用", "AI 应用", "AI产品")), ("电商", ("电商",)),
    )
    districts: tuple[str, ...] = (
        "浦东新区", "徐汇区", "静安区", "杨浦区", "闵行区", "虹口区", "长宁区", "普陀区", "松江区", "嘉定区", "宝山区", "青浦区",
        "奉贤区", "黄浦区", "金山区", "崇明区",
    )
    index_districts: tuple[str, ...] = (
        "浦东新区", "浦东", "黄浦区", "黄浦", "静安区", "静安", "徐汇区", "徐汇", "长宁区", "长宁", "普陀区", "普陀", "虹口区", "虹口",
        "杨浦区", "杨浦", "闵行区", "闵行", "宝山区", "宝山", "嘉定区", "嘉定", "金山区", "金山", "松江区", "松江", "青浦区", "青浦",
        "奉贤区", "奉贤", "崇明区", "崇明",
    )
    experiences: tuple[str, ...] = ("经验不限", "在校生", "应届生", "1年以内", "1-3年", "3-5年", "5-10年", "10年以上")
    educations: tuple[str, ...] = ("学历不限", "初中及以下", "中专/中技", "高中", "大专", "本科", "硕士", "博士")
    duty_headings: tuple[str, ...] = ("职位描述", "岗位描述", "岗位职责", "职位职责", "工作职责", "职责概述", "职责描述")
    requirement_headings: tuple[str, ...] = ("任职要求", "职位要求", "岗位要求", "任职资格")
    body_headings: tuple[str, ...] = ("岗位职责", "职位描述", "工作职责", "工作内容", "任职要求", "职位要求", "工作要求", "能力要求")
    noise_marks: tuple[str, ...] = (
        "与BOSS随时沟通", "求职工具", "工作地址", "APP 有了", "消息 简历", "消息\n简历", "查看更多信息", "升级VIP", "微信扫码分享", "不合适",
    )
    # headings at which a captured text may begin, and headings that are taken off its start
    display_headings: tuple[str, ...] = (
        "职位描述", "岗位描述", "岗位职责", "职位职责", "工作职责", "工作内容", "职责概述", "职责描述", "工作要求", "能力要求", "任职要求", "职位要求",
        "必备要求", "硬性要求",
    )
    leading_headings: tuple[str, ...] = (
        "职位描述", "岗位描述", "岗位职责", "职位职责", "工作职责", "工作内容", "职责概述", "职责描述", "职位要求", "任职要求", "岗位要求", "工作要求",
        "能力要求", "必备要求", "硬性要求", "一、必备要求",
    )
    display_noise: tuple[str, ...] = (
        "BOSS 直聘", "首页", "职位", "公司", "校园•海归", "APP 有了", "消息", "简历", "地图", "求职工具", "打动老板", "查看更多信息", "升级VIP",
        "去App", "收藏", "立即沟通", "工作地址", "与BOSS随时沟通",
    )
    #: Names that stand on the pages of whoever captured them; none by default.
    noise_names: tuple[str, ...] = ()
    chrome_pattern: str = r"不合适|微信扫码|分享|举报|推荐\s*[|｜].{0,12}经理|添加求职期望|城市|工作经验|学历|招聘者|[？?]\s*R\b"
    misread_pattern: str = r"[？?]\s*R\b|上海[^\n]{0,20}\d{1,2}-\d{1,2}年|地图|添加求职期望|基干|古项|植牌|音技|彑联网|宙核|场号"
    page_top_pattern: str = r"^(?:[？?]\s*R?\s*(?:上海[^\d]{0,18}\d{1,2}-\d{1,2}年[^\d]{0,8})?|[\]】）)·•]+)\s*"
    duty_sections: tuple[str, ...] = ("岗位职责", "职位职责", "工作职责", "工作内容")
    requirement_sections: tuple[str, ...] = ("任职要求", "职位要求", "工作要求", "硬性要求", "必备要求")
    closing_sections: tuple[str, ...] = ("岗位职责", "职位职责", "工作职责", "工作内容", "我们提供", "公司福利")
    card_tags: tuple[str, ...] = (
        "C端产品", "B端产品", "用户/功能产品", "中后台产品", "电商产品", "内容产品", "社交产品", "数据产品", "物联网产品", "TO C",
        "TMS运输管理", "承运人业务", "直播/视频产品", "变现", "用户增长", "策略", "AI产品", "海外产品", "其他行业",
    )
    directions: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("AI应用", ("AI", "Agent", "大模型", "智能客服", "机器学习", "算法产品")),
        ("交易", ("电商", "交易", "订单", "商品", "购物", "支付", "会员", "营销", "商业产品")),
        ("履约", ("履约", "物流", "供应链", "配送", "售后", "仓储")),
        ("用户增长", ("增长", "转化", "留存", "召回", "拉新", "活跃", "激励")),
        ("策略", ("搜索", "推荐", "排序", "流量策略", "策略产品", "实验平台")),
        ("数据产品", ("数据产品", "数据平台", "指标平台", "BI产品", "数仓", "数据分析产品")),
        ("内容产品", ("内容", "社区", "博客", "阅读", "音乐", "视频", "直播", "内容分发")),
        ("出行", ("出行", "打车", "汽车", "车载", "座舱", "车辆", "地图导航")),
        ("本地生活", ("本地生活", "到店", "酒旅", "外卖", "团购")),
        ("LBS", ("LBS", "地理位置", "定位服务", "门店位置", "路线规划", "地理信息")),
        ("B端产品", ("B端", "商家端", "企业端", "中后台", "后台系统", "平台产品", "SaaS", "ERP", "CRM", "内部系统")),
        ("用户产品", ("C端", "用户产品", "用户体验", "App", "APP", "小程序", "客户端")),
    )
    default_direction: str = "用户产品"

    @property
    def dimensions(self) -> tuple[str, ...]:
        return tuple(self.weights)

    @property
    def required_weight(self) -> int:
        return sum(w for d, w in self.weights.items() if d not in self.non_blocking)


SHANGHAI_PM = Profile()


def validate_profile(profile: Profile) -> None:
    """Refuse a rubric that could not be scored: R1's rules, before any column is built."""
    problems = []
    if not profile.version.strip():
        problems.append("version is missing")
    if not 0 <= profile.floor_permille <= 1000:
        problems.append("the confidence floor lies outside 0..1")
    if not profile.factors:
        problems.append("no dimension has factors")
    for dimension, classes in profile.factors.items():
        if classes.get(UNKNOWN, 0) is not None:
            problems.append(f"{dimension}: unknown must have no factor")
        problems += [f"{dimension}.{c} lies outside 0..1" for c, v in classes.items() if v is not None and not 0 <= v <= 100]
    ladder = (profile.review_at, profile.consider_at, profile.preferred_at)
    if not all(0 <= x <= 100 for x in ladder) or list(ladder) != sorted(ladder):
        problems.append("thresholds must rise from review over consider to preferred within 0..100")
    if any(isinstance(v, str) or not isinstance(v, (tuple, list)) for v in profile.hard_filters.values()):
        problems.append("hard filters must be lists")
    if problems:
        raise ValueError("; ".join(problems))
