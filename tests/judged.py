"""A small judged collection: memories, questions and which memories answer them, with an embedder that counts topic words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topics of the embedder (name, pattern without regard to case, weight), in their order.
TOPICS = (
    ("tea", r"(乌龙|抹茶|绿茶|红茶|茶)", 2.0),
    ("coffee", r"(咖啡|拿铁|美式|coffee)", 2.0),
    ("milk_alt", r"(乳糖|燕麦奶|豆奶|牛奶|oat|soy|milk)", 1.8),
    ("typescript", r"\b(typescript|ts)\b", 2.2),
    ("python", r"\b(python|pytorch|fastapi)\b", 2.0),
    ("ai_ml", r"(AI|机器学习|模型|embedding|reranker|claude)", 1.5),
    ("meeting", r"(会议|meeting|站会|standup|周会)", 1.8),
    ("schedule", r"(日程|schedule|安排|计划)", 1.6),
    ("git_ops", r"\b(git|commit|rebase|merge|push)\b", 1.8),
    ("git_branch", r"\b(branch|feature/|bugfix/|hotfix/)\b", 2.0),
    ("pr_review", r"(PR|pull.request|review|pull request)", 1.8),
    ("api_rest", r"\b(API|REST|GraphQL|endpoint)\b", 1.8),
    ("api_design", r"(设计规范|规范|语义化|版本|document)", 1.5),
    ("beijing", r"(北京|Beijing|朝阳|望京)", 2.5),
    ("shanghai", r"(上海|Shanghai|浦东|张江)", 2.5),
    ("office", r"(办公室|office|工位|座位|desk)", 1.5),
    ("vegan", r"\b(vegan|素食|有机)\b", 2.2),
    ("allergy", r"(过敏|allergy|不耐受)", 1.8),
    ("lancedb", r"\b(LanceDB|lancedb)\b", 2.5),
    ("postgres", r"\b(Postgres|postgres|MySQL|mysql)\b", 2.0),
    ("redis", r"\b(Redis|redis)\b", 2.2),
    ("database", r"(数据库|database|迁移|migration)", 1.3),
    ("ui_svg", r"\b(SVG|svg|图标)\b", 2.0),
    ("ui_css", r"\b(CSS|css|tailwind|Tailwind|Figma|figma)\b", 2.0),
    ("design", r"(设计|design|前端|frontend|界面)", 1.3),
    ("plugin", r"(插件|plugin|SDK|sdk)", 2.0),
    ("testing", r"(Vitest|vitest|测试|单元|覆盖率)", 2.2),
    ("jira", r"\b(Jira|jira)\b", 2.5),
    ("coding", r"(编程|代码|TypeScript|代码 review|review)", 1.3),
    ("preference", r"(偏好|喜欢|不喜欢|dislike|hate|avoid|不喝|不吃)", 1.2),
    ("decision", r"(规范|要求|必须|统一|should|must|policy)", 1.1),
    ("diet_general", r"(饮食|饮食偏好|健康|health|diet|食品|有机)", 1.4),
)

# The memories (name, text, category, importance, age in days), numbered from 1 in their order.
MEMORIES = (
    ("mem-0001-tea-pref", "用户偏好是乌龙茶，喜欢喝绿茶，也喜欢红茶。下午茶时间通常在3点。", "preference", 0.9, 30),
    ("mem-0002-coffee-dislike", "用户不喜欢冰美式咖啡，对拿铁也不感兴趣。乳糖不耐受。", "preference", 0.85, 25),
    ("mem-0003-ts-plugin", "当前项目统一使用 TypeScript 编写插件逻辑，所有新插件必须遵循插件SDK规范。", "decision", 0.95, 20),
    ("mem-0004-python-ml", "Python 用于机器学习模型训练，团队主要用 PyTorch 框架。", "fact", 0.7, 45),
    ("mem-0005-meeting-monday", "每周一上午10点有团队站会(standup)，讨论上周进展和本周计划。", "fact", 0.8, 15),
    ("mem-0006-git-rebase", "Git 工作流要求 rebase 后再 merge，不要直接 push 到 main 分支。PR 需要至少一个 review。", "decision", 0.9, 10),
    ("mem-0007-api-design", "API 设计规范：RESTful 风格，使用语义化版本号，所有 endpoint 必须有文档。", "decision", 0.85, 12),
    ("mem-0008-beijing-office", "北京办公室在朝阳区望京SOHO，工位分布在B座12层。", "entity", 0.6, 60),
    ("mem-0009-health-vegan", "用户是素食主义者(vegan)，对坚果过敏。健康饮食偏好有机食品。", "preference", 0.95, 5),
    ("mem-0010-lancedb-infra", "基础设施使用 LanceDB 作为向量数据库，Postgres 存储结构化数据，Redis 做缓存。", "entity", 0.8, 8),
    ("mem-0011-ui-frontend", "前端界面设计要求支持 SVG 图标，CSS 使用 Tailwind 框架，统一设计规范在 Figma 中。", "decision", 0.75, 18),
    ("mem-0012-schedule-review", "每周五下午进行代码 review 和技术分享，日程安排由团队 lead 负责。", "fact", 0.7, 22),
    ("mem-0013-python-api", "Python 后端 API 使用 FastAPI 框架，所有接口需要参数校验和错误处理。", "fact", 0.75, 35),
    ("mem-0014-office-shanghai", "上海办公室在浦东新区张江高科，有专门的 AI 实验室和测试设备。", "entity", 0.6, 50),
    ("mem-0015-db-migration", "数据库迁移方案：从 MySQL 迁移到 Postgres 需要处理方言差异，注意自增主键和 JSON 字段兼容性。", "decision", 0.85, 40),
    ("mem-0016-meeting-notes", "会议记录模板：包含议题、决策、待办事项和负责人。每周站会需要更新 Jira 状态。", "fact", 0.65, 28),
    ("mem-0017-ts-testing", "TypeScript 单元测试使用 Vitest 框架，要求覆盖率达到 80% 以上，集成测试使用真实 LanceDB 后端。", "decision", 0.8, 14),
    ("mem-0018-diet-lactose", "用户乳糖不耐受，不能喝含乳糖的牛奶，可以选择燕麦奶或豆奶替代。", "preference", 0.8, 7),
    ("mem-0019-git-branch", "分支命名规范：feature/功能名、bugfix/问题描述、hotfix/紧急修复。主分支保护不允许 force push。", "decision", 0.75, 33),
    ("mem-0020-ai-model", "AI 模型选型：文本生成使用 Claude，向量化用 text-embedding-3-small，reranking 用 Jina Reranker。", "entity", 0.8, 3),
)

# The questions (name, text, numbers of the memories that answer it, the best of them first).
QUESTIONS = (
    ("tea preference", "用户喜欢喝什么茶", (1,)),
    ("coffee dislike", "用户不喜欢什么咖啡", (2,)),
    ("TypeScript plugin", "项目用什么语言写插件", (3,)),
    ("Python ML", "Python 机器学习框架", (4,)),
    ("meeting schedule", "每周会议安排", (5, 12, 16)),
    ("git workflow", "git rebase merge 规范", (6, 19)),
    ("API design", "API 接口设计规范", (7, 13)),
    ("office location", "北京办公室在哪", (8,)),
    ("diet health", "用户的饮食偏好和健康要求", (9, 18, 2)),
    ("database infrastructure", "用什么数据库", (10, 15)),
    ("UI design", "前端 UI 设计要求", (11,)),
    ("testing framework", "TypeScript 测试框架和覆盖率", (17, 3)),
    ("AI model selection", "AI 模型选型 embedding reranker", (20,)),
    ("cross-category: health+diet", "用户乳糖不耐 饮食限制", (18, 9, 2)),
    ("cross-category: git+PR", "branch PR review 规范", (6, 19)),
)

#: A boundary between ASCII word characters and all others, whatever the engine's own \\b takes for a word.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def topic_vector(text: Column) -> Column:
    """Occurrences of each topic's words for each 50 characters (texts under 50 count as 50), times the topic's weight."""
    per = F.greatest(F.lit(1.0), F.length(text) / 50.0)
    return F.array(*(F.regexp_count(text, F.lit("(?i)" + pattern.replace(r"\b", _EDGE))) / per * weight for _, pattern, weight in TOPICS))


def memories(spark: SparkSession) -> DataFrame:
    """doc_id, name, text, importance, vector."""
    rows = spark.createDataFrame([(i, name, text, importance) for i, (name, text, _, importance, _) in enumerate(MEMORIES, 1)], "doc_id long, name string, text string, importance double")
    return rows.withColumn("vector", topic_vector(F.col("text")))


def questions(spark: SparkSession) -> DataFrame:
    """qid, name, text, relevant (ids, the best first), vector."""
    rows = spark.createDataFrame([(i, name, text, list(ids)) for i, (name, text, ids) in enumerate(QUESTIONS, 1)], "qid long, name string, text string, relevant array<long>")
    return rows.withColumn("vector", topic_vector(F.col("text")))
