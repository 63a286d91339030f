"""Patterns, word lists, weights and the seed configuration that results depend on."""

from __future__ import annotations

# ---- signal scorer

URL = r"(?i)https?://[\w\-._~:/?#@!$&'()*+,;=%]+"
CODE = r"```|`[^`\n]+`|(?:^|\n)\s{2,}\S"
LIST = r"(?m)^\s*(\d+[.)]\s+|[-*•]\s+).+"
GUIDE = (
    r"(?iu)\b(guide|tutorial|how[- ]?to|step\s+\d+|prompt|setup|install|instruction|faq|гайд|инструкци\w*|туториал|промпт|"
    r"настроить|настройк\w*|подключить|схем\w*|шаг\s+\d+)\b"
)
QUESTION = (
    r"(?iu)(\?|\bhow\b|\bwhere\b|\bwho\b|\bcan\b|\bкак\b|\bпочему\b|\bгде\b|\bкто\s+знает\b|\bкто\s+нашел\b|\bподскажите\b|\bесть\s+у\s+кого\b)"
)
SOURCE = (
    r"(?iu)\b(link|source|site|endpoint|provider|proxy|account|accounts|prompt|repo|github|shop|seller|ссылк\w*|сайт|где\s+взять|"
    r"где\s+купить|провайдер|промпт|акк|акки|аккаунт\w*|ключ|эндпоинт|прокси|китайск\w*|продавец|купить|покупать)\b"
)
ACKNOWLEDGEMENTS = ["ok", "okay", "thanks", "thx", "+", "+1", "ок", "окей", "спасибо", "ага", "ясно", "понятно"]
SIGNAL_WEIGHTS = {
    "guideMarkers": 0.24, "questionMarkers": 0.22, "sourceMarkers": 0.24, "links": 0.18, "code": 0.22, "listStructure": 0.16,
    "replyContext": 0.16, "activeDiscussion": 0.14, "topicContext": 0.08,
}
LENGTH_STEPS = [(500, 0.16), (250, 0.12), (120, 0.08), (32, 0.04)]
HUMAN, BOT = 0.04, -0.18
ACK_PENALTY, SHORT_PENALTY, EMPTY_PENALTY = -0.60, -0.24, -0.40
SIGNAL_THRESHOLD = 0.30

# ---- settings and rules after all migrations

SETTINGS = {"skip_bots": True, "min_length": 12, "blacklist": "куплю,продам,реклама", "publication_mode": "WITH_MODERATION"}
CHAIN = {"include_replies": True, "window_minutes": 5, "max_messages": 20}

#: order, id, name, action, conditions.
RULES = [
    (-1, 2007, "Exclude all bots", "EXCLUDE", '[{"type":"SENDER_IS_BOT","value":"true"}]'),
    (5, 2003, "Exclude ultra short noise", "EXCLUDE", '[{"type":"LENGTH_LT","value":"5"}]'),
    (10, 2001, "Exclude tiny noise", "EXCLUDE", '[{"type":"LENGTH_LT","value":"8"}]'),
    (
        15, 2004, "Exclude reaction chatter", "EXCLUDE",
        '[{"type":"LENGTH_LT","value":"32"},{"type":"KEYWORD_MATCH","value":"ок,окей,ага,понял,ясно,спс,лол,ахаха,хвхв,жесть,пздц,совпадение"}]',
    ),
    (20, 2002, "Exclude short bot noise", "EXCLUDE", '[{"type":"SENDER_IS_BOT","value":"true"},{"type":"LENGTH_LT","value":"20"}]'),
    (
        25, 2005, "Include AI value signals", "INCLUDE",
        '[{"type":"KEYWORD_MATCH","value":"gpt,claude,opus,sonnet,codex,cursor,openai,anthropic,api,model,модель,лимит,credits,free,халява,доступ,release,релиз,'
        'provider,endpoint,proxy,repo,github,акк,акки,аккаунт,аккаунты,сайт,ссылка,ключ,провайдер,эндпоинт,прокси,купить,покупать,где купить,где взять,'
        'кто нашел,кто знает,есть у кого"}]',
    ),
    (
        30, 2008, "Include useful requests and sources", "INCLUDE",
        '[{"type":"KEYWORD_MATCH","value":"кто знает,кто нашел,подскажите,есть у кого,где купить,где взять,сайт,ссылка,провайдер,ключ,эндпоинт,прокси,'
        'акк,акки,аккаунт,аккаунты,промпт,настроить,настройка,подключить,инструкция"}]',
    ),
    (
        32, 2009, "Include practical questions", "INCLUDE",
        '[{"type":"LENGTH_GT","value":"24"},{"type":"REGEX_MATCH","value":"(?iu)(\\\\?|\\\\bкак\\\\b|\\\\bгде\\\\b|\\\\bкто\\\\b|\\\\bподскажите\\\\b|\\\\bесть у кого\\\\b|'
        '\\\\bделает\\\\w*\\\\b|\\\\bподписк\\\\w*\\\\b|\\\\bнастро\\\\w*\\\\b|\\\\bкупи\\\\w*\\\\b|\\\\bссылк\\\\w*\\\\b)"}]',
    ),
    (
        35, 2006, "Include how-to markers", "INCLUDE",
        '[{"type":"KEYWORD_MATCH","value":"guide,гайд,tutorial,туториал,how to,как сделать,инструкция,шаг,prompt,промпт,setup,install,настроить,настройка,подключить,схема,разбор"}]',
    ),
]

# ---- classifiers

KEYWORDS = (
    "gpt,claude,opus,sonnet,llm,ai,нейросеть,нейросети,нейронка,prompt,промпт,rag,agent,cursor,codex,openai,anthropic,api,model,модель,"
    "credits,free,бесплатно,халява,релиз,release,гайд,туториал"
)
LINEAR_MODEL = {
    "bias": -0.35, "threshold": 0.75, "normalization": "sigmoid",
    "features": {
        "text_length_norm": 0.25, "reply_count_norm": 0.15, "has_ai_marker": 1.10, "has_value_marker": 0.75, "has_guide_marker": 0.65,
        "has_tool_marker": 0.55, "has_release_marker": 0.45, "has_url": 0.20, "has_topic": 0.10, "is_not_bot": 0.10, "has_code_marker": 0.20,
        "has_deadline_marker": 0.35, "has_price_marker": 0.30, "has_question_marker": 0.18,
    },
}
LINEAR_DEFAULT_THRESHOLD = 0.58
#: Substrings by feature; a feature with a single list is 1 if any occurs.
LINEAR_MARKERS = {
    "has_url": ["http://", "https://"],
    "has_ai_marker": ["gpt", "claude", "opus", "sonnet", "llm", "ai", "нейросет", "prompt", "cursor", "codex", "openai", "anthropic", "model", "модель", "api"],
    "has_value_marker": ["free", "бесплат", "халява", "$", "скидк", "credits", "кредит", "дают", "лимит", "доступ", "today", "сегодня", "завтра", "until", "до завтра"],
    "has_guide_marker": ["guide", "гайд", "tutorial", "туториал", "how to", "как сделать", "шаг", "инструкция", "step 1", "1.", "2.", "3."],
    "has_tool_marker": ["docker", "n8n", "comfyui", "cursor", "codex", "repo", "github", "sdk"],
    "has_release_marker": ["release", "релиз", "launched", "launch", "update", "обновление", "new model", "новая модель"],
    "has_question_marker": ["?", "как ", "почему", "где ", "зачем", "когда "],
    "has_code_marker": ["`", "npm ", "docker ", "git ", "curl ", "mvn "],
    "has_price_marker": ["$", "usd"],
    "has_deadline_marker": ["today", "сегодня", "tomorrow", "завтра", "до завтра", "limited"],
}
CASCADE_THRESHOLD, EARLY_STOP = 0.75, 0.90
COST_RANK = {"KEYWORD": 0, "REGEX": 1, "LINEAR_MODEL": 2, "LLM": 3}

# ---- the deterministic stand-in for a language model

MOCK_TOPICS = ["gpt", "claude", "anthropic", "openai", "api", "model", "codex", "cursor", "kimi", "gemini", "deepseek", "mistral", "модель", "нейросет", "клод"]
MOCK_PATTERNS = {
    "url": r"(?i)https?://\S+",
    "code": r"(?i)```|`[^`\n]+`|\b(curl|npm|pnpm|yarn|docker|git|mvn|gradle|python|java)\b",
    "list": r"(?m)^\s*(\d+[.)]\s+|[-*•]\s+).+",
    "guide": r"(?i)\b(guide|tutorial|how\s+to|how-to|checklist|step\s+\d+|гайд|инструкц|шаг\s+\d+)\b",
    "release": r"(?i)\b(release|launched|launch|update|pricing|credits?|limits?|quota|access|api|endpoint|model|benchmark|tokens?|context|релиз|обновление|цена|лимит|доступ|токен)\b",
    "question": r"(?i)(\?|\bhow\b|\bwhere\b|\bwhy\b|\banyone\b|\bhelp\b|\bкак\b|\bгде\b|\bпочему\b|\bкто\s+нибудь\b)",
    "action": r"(?i)\b(do|use|setup|configure|connect|run|install|register|check|get|take|switch|compare|test|deploy|enable|сделай|нужно|надо|запустить|настроить|подключить|регистрируемся|заходим)\b",
    "chatter": r"(?i)\b(lol|lmao|bro|dude|thanks|thank\s+you|okay|ok|sure|got\s+it|nice|cool|hype|trash|sucks|лол|ахах|ага|понял|спасибо|жесть|кринж)\b",
    "benchmark": r"(?i)\b(benchmark|latency|pricing|tokens?|context|window|sdk|endpoint|quota|credits?|rate\s*limit|release\s*notes?|бенч|токен|контекст|прайс)\b",
    "promo": r"(?i)\b(ref|referral|affiliate|subscribe|bonus|promo|coupon|discount|реф|бонус|бесплат|скидка)\b|t\.me/|youtube\.com|youtu\.be",
    "casual": r"(?i)^\s*(ok|okay|yeah|yep|nah|bro|dude|thanks|thank\s+you|sure|got\s+it|ок|ага|спасибо|понял)\b",
}
PROMPT_MARKERS = ["Message chain to classify:", "Source message chain:", "Messages to classify:"]

# ---- guides

#: Substrings (any) and the tag they stand for, in order.
FALLBACK_TAGS = [
    (["онбординг"], "онбординг"), (["paywall", "пейвол"], "пейвол"), (["подпис"], "подписка"), (["оплат", "карт"], "оплата"), (["google play"], "Google Play"),
    (["app store"], "App Store"), (["android"], "Android"), (["ios"], "iOS"), (["игр"], "игры"), (["прилож"], "приложение"), (["api"], "API"),
    (["монетиза"], "монетизация"), (["обновлен"], "обновление"), (["фидбек"], "фидбек"),
]
PRODUCT_TAG = r"\b(Telegram|Google Play|App Store|Android|iOS|OpenAI|Anthropic|Claude|Gemini|DeepSeek|Cursor|Codex|GPT-[\w.-]+)\b"
CAPITALISED_TAG = r"(?<!\p{L})([A-ZА-Я][\p{L}\d.+-]{2,}(?:\s+[A-ZА-Я][\p{L}\d.+-]{2,}){0,2})"
DEFAULT_TAG = "гайд"
TOKEN_PRICE = 0.00002
AUTO_PUBLISH_CONFIDENCE = 0.85
