"""Term lists, templates and tables that results depend on.

They must equal the published behaviour for equal results, so they are stated
as plain data in their natural order. Callers may pass their own.
"""

from __future__ import annotations

from dataclasses import dataclass

# Query term lists.
LOOKUP_TERMS = ("谁", "作者", "第一作者", "通讯作者", "年份", "哪一年", "单位", "机构", "在哪里")
MEMORY_INTENT_TERMS = ("刚才", "之前", "前面", "上面", "记忆", "记住", "历史", "对话", "上一轮", "上次")
CONCEPT_TERMS = (
    "讲一讲", "讲讲", "介绍一下", "介绍", "概述", "解释一下", "解释", "说说", "科普", "是什么", "定义", "原理",
)
MEMORY_STOP_TERMS = (
    "请", "帮", "我", "一下", "讲", "讲讲", "一讲", "介绍", "概述", "解释", "说说", "科普", "什么", "是什么",
    "这个", "那个", "如何", "怎么",
)
PRONOUN_TERMS = ("它", "这个", "该方法", "这篇", "上述", "前面")
PREFERENCE_TERMS = ("优先", "尽量", "希望", "不要", "最好", "必须")
RESTRICTIVE_TERMS = (
    "当前的知识库", "当前知识库", "当前的知识库和网络搜索", "当前知识库和网络搜索", "无法从当前", "网络搜索中找不到",
    "网络搜索没有返回", "公开搜索没有返回", "没有命中文档证据", "本地知识库没有命中", "补充本地资料", "工具调用失败",
    "当前没有足够的工具观察结果",
)

# Intents in the order they are tried; (intent, terms in the text, terms in the lower-cased text).
INTENT_RULES = (
    ("lookup", LOOKUP_TERMS, ()),
    ("taxonomy", ("两类", "分类", "分别", "分为哪"), ("types of", "categories")),
    ("robustness", ("低信噪比", "低 SNR", "鲁棒", "优势", "稳", "噪声", "信道变化"), ("snr", "noisy channel", "robust")),
    ("compression", ("省带宽", "少传", "少发", "冗余比特", "压缩", "开销", "省流", "保持意思", "保持理解"), ()),
    ("comparison", ("对比", "比较", "区别", "差异", "取舍"), ()),
    ("trend", ("趋势", "未来", "发展", "挑战", "机会", "方向"), ()),
    ("architecture", ("架构", "系统", "模块", "流程", "pipeline", "链路"), ()),
    ("technology_choice", ("选型", "为什么选", "模型", "方法", "算法", "技术"), ()),
    ("evaluation", ("评估", "指标", "benchmark", "实验", "效果"), ()),
    ("safety", ("安全", "隐私", "可信", "攻击"), ("security", "privacy")),
    ("concept_overview", CONCEPT_TERMS, ()),
)
DEFAULT_INTENT = "general"

# Suffixes of planned searches.
LOOKUP_SUFFIXES = ("作者", "标题页", "摘要")
GENERAL_SUFFIXES = ("关键概念", "结论 依据", "摘要")
BROADEN_SUFFIXES = ("第一页", "全文", "介绍")
CONCEPT_SUFFIX = " 定义 原理 应用"


@dataclass(frozen=True)
class Expansion:
    """Terms added when a trigger matches; ``never`` vetoes, intents restrict."""

    terms: tuple[str, ...]
    text: tuple[str, ...] = ()
    lower: tuple[str, ...] = ()
    lower_unless: tuple[str, str] | None = None  # (term, veto) in the lower-cased text
    intent: str | None = None
    not_intent: str | None = None
    always: bool = False


# Domain expansion. The gate decides whether any rule applies at all.
EXPANSION_GATE_TEXT = ("语义", "通信", "车联网", "高速", "比特", "少传", "理解", "信噪比", "任务导向")
EXPANSION_GATE_LOWER = (
    "semantic", "deepsc", "r-deepsc", "switchac", "dib", "ddib", "snr", "sentence similarity", "superimposed pilot",
    "selective retransmission", "6g",
)
_NOISE = dict(text=("语义噪声",), lower=("r-deepsc", "semantic noise"))
EXPANSIONS = (
    Expansion(("R-DeepSC", "literal semantic noise", "adversarial semantic noise"), **_NOISE),
    Expansion(("calibrated self-attention", "adversarial training"), **_NOISE, not_intent="taxonomy"),
    Expansion(
        ("DeepSC", "sentence similarity", "Transformer", "低SNR", "语义相似度", "句子语义"),
        text=("低信噪比", "句子意思"), lower=("sentence similarity",), lower_unless=("deepsc", "r-deepsc"),
    ),
    Expansion(
        ("DeepSC-ST", "语音识别", "语音合成", "语义特征", "文本恢复", "音频恢复"), text=("语音",), lower=("deepsc-st",),
    ),
    Expansion(
        ("任务导向语义通信", "边缘推理", "information bottleneck", "DIB", "DDIB", "rate-relevance tradeoff"),
        text=("任务导向", "边缘"), lower=("task-oriented", "dib", "ddib"),
    ),
    Expansion(
        ("selective retransmission", "选择性重传", "多设备语义通信", "错误语义片段", "边缘推理"),
        text=("重传",), lower=("selective retransmission",),
    ),
    Expansion(
        ("superimposed pilot", "叠加导频", "高速移动", "信道估计", "多普勒频移"),
        text=("导频",), lower=("superimposed pilot", "pilot"),
    ),
    Expansion(
        ("SwitchAC-SIP", "动态信道", "文本语义", "音频语义", "带宽动态分配"),
        text=("文本和音频", "动态信道"), lower=("switchac",),
    ),
    Expansion(
        ("语义压缩", "冗余比特", "恢复意义", "语义相似度", "传输开销", "频谱效率"),
        text=("压缩", "省流", "频谱", "带宽", "开销", "少传", "理解", "比特"),
    ),
    Expansion(("语义通信", "语义编码", "语义解码", "任务导向", "知识库", "信道状态"), always=True),
    Expansion(
        ("端到端架构", "语义编码器", "语义解码器", "信道编码", "反馈闭环", "边缘部署"), always=True, intent="architecture",
    ),
    Expansion(
        ("Transformer", "知识图谱", "多模态模型", "端侧推理", "轻量化模型", "鲁棒训练"),
        always=True, intent="technology_choice",
    ),
    Expansion(
        ("6G", "多模态语义通信", "边缘智能", "标准化", "安全隐私", "语义原生网络"), always=True, intent="trend",
    ),
    Expansion(
        ("语义相似度", "任务成功率", "频谱效率", "压缩率", "QoE", "鲁棒性"), always=True, intent="evaluation",
    ),
    Expansion(("隐私保护", "对抗攻击", "可信语义", "鲁棒性", "安全编码"), always=True, intent="safety"),
    Expansion(
        ("比特传输", "香农通信", "语义层", "任务成功率", "端到端优化"), always=True, intent="comparison",
    ),
    Expansion(
        ("高速移动", "多普勒频移", "快速衰落", "信道时变", "低时延", "鲁棒性"),
        text=("高速", "车联网", "移动", "高铁", "无人机"),
    ),
    Expansion(
        ("跨模态对齐", "图像语义", "语音语义", "文本语义", "多模态融合"), text=("多模态", "图像", "语音", "文本", "视频"),
    ),
    Expansion(
        ("语义压缩", "冗余比特", "传输开销", "频谱效率", "低比特率"), text=("压缩", "省流", "频谱", "带宽", "开销"),
    ),
)

# Step-back templates; the focus comes first.
STEP_BACK = {
    "lookup": " 标题页 作者 年份 机构 元数据",
    "taxonomy": " 有哪些类型 分类 定义 区别 代表机制",
    "robustness": " 如何在低SNR noisy channel 快速变化信道下保持语义相似度和任务鲁棒性",
    "compression": " 如何减少冗余比特 传输开销和带宽占用 同时保持恢复意义和任务准确率",
    "architecture": " 系统架构由哪些模块组成 如何形成端到端语义传输闭环",
    "technology_choice": " 技术选型需要在模型能力 鲁棒性 延迟 成本 可部署性之间如何取舍",
    "trend": " 面向未来6G和智能网络的发展趋势 挑战 标准化 应用方向",
    "evaluation": " 应如何评价语义保持 任务效果 通信效率 鲁棒性和用户体验",
    "comparison": " 与传统比特通信相比 在目标 表征 评价指标和系统优化上有什么差异",
    "safety": " 在隐私 安全 可信 对抗鲁棒性方面需要解决哪些核心问题",
}
STEP_BACK_DEFAULT = " 背后的核心概念 原理 适用场景和局限是什么"
STEP_BACK_LIMIT = 180

# Hypothetical-document templates (text after the focus, length limit, append expansions).
HYDE = {
    "lookup": (" 的标题页通常包含作者、机构、年份、摘要和关键词，可用于定位精确事实。", 240, False),
    "taxonomy": (" 的回答应定位分类定义、类别差异、代表机制和适用条件，而不是泛化到无关趋势。", 240, False),
    "robustness": (
        " 的关键是利用语义编码、上下文表示、低SNR鲁棒训练和信道感知机制，在 noisy channel 下优先保持句子语义和任务效果。",
        260, False,
    ),
    "compression": (
        " 通过语义压缩、冗余比特过滤、information bottleneck 和任务相关特征传输降低开销，同时让接收端恢复意义并保持推理准确率。",
        260, False,
    ),
    "architecture": (" 的架构通常包括语义编码器、语义解码器、知识库、信道编码、反馈闭环和任务评价模块。", 260, True),
    "technology_choice": (" 的技术选型需要比较 Transformer、知识图谱、多模态模型、轻量化端侧推理和鲁棒训练。", 260, True),
    "trend": (" 的未来趋势包括6G语义原生网络、多模态融合、边缘智能、标准化、安全隐私和可解释评估。", 260, True),
    "evaluation": (" 的评估需要同时关注语义相似度、任务成功率、频谱效率、压缩率、QoE、低时延和鲁棒性。", 260, True),
    "comparison": (" 强调传输含义和任务效果，区别于传统通信只优化比特级可靠性和吞吐量。", 260, True),
}
HYDE_DEFAULT = (" 涉及定义、原理、系统挑战、应用场景、评价指标和未来方向。", 260, True)
HYDE_NOISE = (
    " 通过 calibrated self-attention、语义置信度校准和 adversarial training 抵抗 literal semantic noise "
    "与 adversarial semantic noise，提升鲁棒性。",
    260,
)
HYDE_NOISE_LOWER = ("r-deepsc", "semantic noise")
HYDE_NOISE_TEXT = ("语义噪声",)
HYDE_SKIPPED_INTENTS = ("lookup", "taxonomy")
HYDE_EXPANSIONS = 10
LEXICAL_TERMS = 18

# Variant strategies, weights and reasons.
VARIANTS = {
    "baseline": (1.0, "legacy planned search query"),
    "baseline_expansion": (1.0, "retain legacy planned_search_queries for recall safety"),
    "standalone": (0.98, "resolve short follow-up or pronoun-heavy query into a standalone search query"),
    "step_back": (0.56, "retrieve higher-level principles and architecture context"),
    "lexical_domain_expansion": (0.68, "combine lexical keywords with domain expansion terms for sparse retrieval"),
    "hyde": (0.54, "HyDE-style hypothetical answer document for dense retrieval"),
}

# Live-tool routing.
WEATHER_TERMS = ("天气", "气温", "温度", "下雨", "降雨", "降水", "风力", "风速", "冷不冷", "热不热")
PUBLIC_WEB_TERMS = ("联网", "网上", "网络上", "公开资料", "搜索", "最新", "新闻", "官网", "实时")
GENERAL_PUBLIC_TERMS = ("是谁", "谁是", "是什么", "在哪里", "哪一年", "什么时候", "多少", "几岁")
LOCAL_CONTEXT_TERMS = (
    "项目", "本项目", "系统", "资产", "论文", "代码", "仓库", "刚才", "记录", "检索", "记忆", "TODO", "todo",
)
ROUTES = {
    "weather": (
        "realtime_weather", "weather_qa", "weather_lookup", 0.92,
        "用户询问天气/气温等实时信息，需要调用外部天气工具，而不是检索本地知识库。",
    ),
    "web": (
        "public_web_lookup", "public_web_qa", "public_web_search", 0.74,
        "用户显式询问公开网络资料或最新信息，需要调用公开搜索工具。",
    ),
    "general": (
        "public_web_lookup", "public_web_qa", "public_web_search", 0.66,
        "用户询问通用公开事实，且问题没有明显绑定当前项目资料，优先调用公开搜索工具。",
    ),
}
LOCAL_TOOL = "local_project_rag"
# The planner's tool catalog (tool, skill, intent, description).
PLANNER_CATALOG = (
    (
        "weather_lookup", "weather_qa", "realtime_weather",
        "查询当前或近期天气事实。适用于天气、气温、降水、风速，以及基于天气事实的出行/穿衣/活动适宜性判断。",
    ),
    (
        "public_web_search", "public_web_qa", "public_web_lookup",
        "查询公开网络资料。适用于最新消息、官网信息、公开事实、非本项目资料的问题。",
    ),
)
PLANNER_ALIASES = {
    "": "local_project_rag", "none": "local_project_rag", "no_tool": "local_project_rag", "local": "local_project_rag",
    "local_rag": "local_project_rag", "project_rag": "local_project_rag", "weather": "weather_lookup",
    "weather_qa": "weather_lookup", "web_search": "public_web_search", "search": "public_web_search",
    "public_web": "public_web_search",
}
FALSE_WORDS = ("0", "false", "no", "off", "否", "不")

# Gazetteer in match order (name, latitude, longitude, time zone, display name).
PLACES = (
    ("北京", 39.9042, 116.4074, "Asia/Shanghai", "北京"),
    ("北京市", 39.9042, 116.4074, "Asia/Shanghai", "北京"),
    ("上海", 31.2304, 121.4737, "Asia/Shanghai", "上海"),
    ("上海市", 31.2304, 121.4737, "Asia/Shanghai", "上海"),
    ("广州", 23.1291, 113.2644, "Asia/Shanghai", "广州"),
    ("深圳", 22.5431, 114.0579, "Asia/Shanghai", "深圳"),
    ("杭州", 30.2741, 120.1551, "Asia/Shanghai", "杭州"),
    ("南京", 32.0603, 118.7969, "Asia/Shanghai", "南京"),
    ("成都", 30.5728, 104.0668, "Asia/Shanghai", "成都"),
    ("武汉", 30.5928, 114.3055, "Asia/Shanghai", "武汉"),
    ("西安", 34.3416, 108.9398, "Asia/Shanghai", "西安"),
    ("重庆", 29.5630, 106.5516, "Asia/Shanghai", "重庆"),
    ("天津", 39.3434, 117.3616, "Asia/Shanghai", "天津"),
    ("香港", 22.3193, 114.1694, "Asia/Hong_Kong", "香港"),
    ("台北", 25.0330, 121.5654, "Asia/Taipei", "台北"),
    ("纽约", 40.7128, -74.0060, "America/New_York", "纽约"),
    ("伦敦", 51.5072, -0.1276, "Europe/London", "伦敦"),
    ("东京", 35.6764, 139.6500, "Asia/Tokyo", "东京"),
)

# Agent actions.
TODO_WORDS = ("todo", "待办")
TODO_CREATE_WORDS = ("创建", "新建", "加入", "添加", "生成")
TODO_LIST_WORDS = ("列出", "有哪些", "查看", "列表")
MEMORY_WRITE_WORDS = ("记住", "请记住", "帮我记")
MEMORY_WRITE_VETO = ("记住了什么", "刚才")
MEMORY_READ_WORDS = ("记忆", "刚才", "记住")
OUTING_WORDS = ("天气", "出游")
ASSET_WORDS = ("资产", "文档", "资料")
CALCULATE_WORD = "计算"
AGENT_WEATHER_WORDS = ("天气", "气温", "温度", "出游", "下雨", "降水")
AGENT_WEB_WORDS = ("联网", "搜索", "最新", "新闻", "官网", "公开资料")
AGENT_ALIASES = {
    "finish": "final_answer", "final": "final_answer", "answer": "final_answer", "rag": "local_rag_search",
    "search_local": "local_rag_search", "web_search": "public_web_search", "weather": "weather_lookup",
    "create_todo": "todo_create", "list_todo": "todo_list", "list_todos": "todo_list", "list_assets": "asset_list",
    "memory": "memory_read", "remember": "memory_write", "calculate": "calculator",
}
# Aliases used when decisions are evaluated.
DECISION_ALIASES = {
    "answer": "final_answer", "final": "final_answer", "finish": "final_answer", "rag": "local_rag_search",
    "search_local": "local_rag_search", "local_search": "local_rag_search", "web_search": "public_web_search",
    "search_web": "public_web_search", "weather": "weather_lookup", "memory": "memory_read",
    "remember": "memory_write", "create_todo": "todo_create", "list_todo": "todo_list", "list_todos": "todo_list",
    "list_assets": "asset_list", "calculate": "calculator",
}
FINAL_ACTION = "final_answer"
INVALID_ACTION = "invalid_json"

# Tool registry (tool, skill, intent, read only, risk, tags).
TOOLS = (
    ("local_rag_search", "project_literature_rag", "project_evidence_lookup", True, "low", ("rag", "citation", "literature")),
    ("weather_lookup", "fieldwork_context", "realtime_weather", True, "low", ("weather", "realtime")),
    ("public_web_search", "public_literature_lookup", "public_web_lookup", True, "medium", ("web", "freshness")),
    ("memory_read", "research_memory", "memory_lookup", True, "low", ("memory", "context")),
    ("memory_write", "research_memory_write", "memory_write", False, "medium", ("memory", "side-effect")),
    ("todo_create", "research_task_management", "todo_create", False, "medium", ("todo", "side-effect")),
    ("todo_list", "research_task_management", "todo_list", True, "low", ("todo", "inventory")),
    ("asset_list", "asset_inventory", "asset_inventory", True, "low", ("asset", "inventory")),
    ("calculator", "quantitative_check", "calculation", True, "low", ("calculation", "experiment")),
)
# Skill registry (skill, title, tags).
SKILLS = (
    ("project_literature_rag", "项目文献检索", ("rag", "citation", "literature")),
    ("public_literature_lookup", "公开资料检索", ("web", "freshness", "public-source")),
    ("research_memory", "研究记忆回溯", ("memory", "context")),
    ("asset_inventory", "资料资产盘点", ("asset", "inventory")),
    ("quantitative_check", "定量校验", ("calculation", "experiment")),
    ("research_task_management", "研究任务管理", ("todo", "workflow")),
    ("fieldwork_context", "外出调研环境", ("weather", "fieldwork")),
    ("research_memory_write", "研究偏好记录", ("memory", "write")),
)
TOOL_ACTIONS = tuple(t[0] for t in TOOLS)
VALID_ACTIONS = TOOL_ACTIONS + (FINAL_ACTION,)
READ_ONLY_PREFIXES = ("get", "list", "search", "read")

# Fact types that may be stored.
FACT_TYPES = ("fact", "decision", "preference", "open_question", "progress")
