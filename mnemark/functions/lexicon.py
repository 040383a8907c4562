"""Word lists, patterns and tables that results depend on.

Fixed values: they must equal those of the engine whose answers this library gives, so they stand here as they are. In
patterns ``\\b`` is a boundary of ASCII words and ``\\s`` the white space of :data:`text.SPACE`; all ignore case.
"""

# Terms that say nothing of a query's subject.
GENERIC_TERMS = (
    "again", "apply", "consistent", "conversation", "conversations", "continue", "decision", "decisions", "history", "keep", "prior", "problem",
    "session", "sessions", "task", "tasks", "thing", "things", "work", "worked", "working",
)

# Words that frame a question about a time.
TEMPORAL_SCAFFOLD_TERMS = (
    "can", "config", "configuration", "did", "do", "for", "friday", "here", "last", "monday", "our", "ours", "project", "recall", "remember", "repo",
    "repository", "saturday", "setup", "sunday", "thursday", "this", "today", "tuesday", "wednesday", "week", "what", "when", "where", "which", "with",
    "workspace", "you", "your", "yesterday",
)

# Terms that a term stands for too.
ALIASES = {
    "audit": ("auditable", "override", "scope"),
    "auditable": ("audit", "override", "scope"),
    "backfill": ("restore", "rollback", "snapshot"),
    "chat": ("conversation", "session"),
    "lore": ("memory", "history", "session"),
    "conversation": ("chat", "session", "history"),
    "conversations": ("chat", "session", "history"),
    "memory": ("remember", "history", "lore"),
    "override": ("scope", "audit", "manual"),
    "past": ("history", "prior"),
    "previous": ("history", "prior"),
    "prompt": ("shaping", "context", "classification"),
    "phase": ("slice", "stage", "shaping", "prompt"),
    "recall": ("memory", "history", "remember"),
    "remember": ("memory", "history", "lore"),
    "remembering": ("memory", "history", "lore"),
    "restore": ("rollback", "snapshot", "backfill"),
    "retrieval": ("memory", "history", "lore"),
    "rollback": ("restore", "snapshot", "backfill"),
    "controlled": ("backfill", "rollback", "restore", "snapshot"),
    "scope": ("override", "audit", "transferable", "global", "repo"),
    "session": ("conversation", "history"),
    "shaping": ("prompt", "context", "classification"),
    "snapshot": ("restore", "rollback", "backfill"),
}

# What a text about one repository, about practice that moves, and about manners in general speaks of.
REPO_SPECIFIC = (
    r"\bthis repo\b", r"\bthis repository\b", r"\bcurrent repo\b", r"\bcurrent repository\b", r"\bin this repo\b", r"\bin this repository\b",
    r"\bfor this repo\b", r"\bfor this repository\b", r"\bon this branch\b", r"\bpackage\.json\b", r"\btsconfig\b", r"\bworkflow file\b", r"\bworktree\b",
)
TRANSFERABLE = (
    r"\bci\b", r"\bcircleci\b", r"\bgithub actions\b", r"\bworkflow migration\b", r"\bmigration\b", r"\brollout\b", r"\bplaybook\b", r"\bpattern\b",
    r"\bexample\b", r"\bexamples\b", r"\breuse\b", r"\btesting\b", r"\bauth\b", r"\bdeployment\b", r"\brelease\b",
)
GLOBAL_PREFERENCE = (
    r"\bstyle\b", r"\btone\b", r"\bvoice\b", r"\brespond\b", r"\breply\b", r"\bhow you\b", r"\bwhen i call you\b", r"\bassistant\b", r"\byour name\b",
    r"\bcall you\b", r"\bcolleague\b", r"\bcoworker\b", r"\bteammate\b", r"\bcollaborative\b", r"\blight(?:-|\s)?humou?r\b", r"\bhumou?r\b", r"\bjokes?\b",
)

# How an assistant is given or called by a name, in order, and words that are no names.
ASSISTANT_NAMES = (
    r"\bcall (?:you|yourself)\s+([a-z][a-z0-9_-]{1,31})\b", r"\byour name is\s+([a-z][a-z0-9_-]{1,31})\b", r"\buse (?:the )?name\s+([a-z][a-z0-9_-]{1,31})\b",
    r"\bused the name\s+([a-z][a-z0-9_-]{1,31})\b", r"\bwhy i used the name\s+([a-z][a-z0-9_-]{1,31})\b",
    r"^(?:hi|hello|hey)\s+([a-z][a-z0-9_-]{2,20})(?:[!?,.\s]|$)", r"^([a-z][a-z0-9_-]{2,20})[,:!?]\s",
)
NO_NAMES = (
    "again", "all", "assistant", "can", "continue", "copilot", "everyone", "folks", "hello", "help", "hey", "hi", "okay", "please", "planning", "refactor",
    "researching", "serious", "team", "there", "thanks", "this", "what", "when", "where", "why", "how", "who", "would", "could", "should", "update",
)

# What a prompt says of its need.
TEMPORAL_SIGNALS = (
    "today", "yesterday", "last week", "last thursday", "last friday", "last monday", "last tuesday", "last wednesday", "last saturday", "last sunday",
)
CONSISTENCY_SIGNALS = (
    "remember", "again", "rejected", "don't propose", "do not propose", "continue", "blocker", "pending", "what did we do", "as usual",
)
TRANSFER_SIGNALS = (
    "example", "examples", "like before", "similar to", "same way", "other repo", "other repos", "other project", "other projects", "cross repo",
    "cross-repo", "reuse", "pattern", "playbook", "ci migration", "github actions", "circleci", "workflow migration",
)
LOCAL_SCOPE = (
    r"\b(?:in|for|within)\s+this\s+(?:repo|repository|workspace|project|config|configuration)\b",
    r"\bwith\s+this\s+(?:repo|repository|workspace|project|config|configuration)\b",
    r"\bhere\s+in\s+this\s+(?:repo|repository|workspace|project|config|configuration)\b",
    r"\bthis\s+(?:repo|repository|workspace|project|config|configuration)\s+only\b",
    r"\bcurrent\s+(?:repo|repository|workspace|project|config|configuration)\s+only\b",
    r"\brepo[-\s]local\b",
)
COLLEAGUE_STYLE = (
    r"\b(?:like|as)\s+(?:a\s+)?(?:colleague|coworker|co-worker|teammate|peer)\b",
    r"\bfriendly\s+(?:colleague|coworker|co-worker|teammate|peer)\b",
    r"\bteammate[-\s]?like\b",
)
COLLABORATIVE_STYLE = (
    r"\bcollaborative\b", r"\bwork\s+together\b", r"\bsolve\s+(?:this|it|problems?)\s+together\b", r"\bpair\s+(?:with|on)\s+me\b",
    r"\bwe\s+(?:can|should|need to)?\s*solve\s+(?:this|it|problems?)\s+together\b",
)
LIGHT_HUMOUR = (
    r"\blight\s+(?:humou?r|jokes?)\b", r"\blittle\s+(?:humou?r|jokes?)\b", r"\b(?:bit|touch)\s+of\s+(?:humou?r|jokes?)\b",
    r"\b(?:feel free|okay)\s+to\s+(?:use|add)\s+(?:a\s+)?(?:little\s+)?humou?r\b", r"\bplayful\b",
)
NO_JOKES = (
    r"\bno\s+jokes?\b", r"\bwithout\s+jokes?\b", r"\bskip\s+the\s+jokes?\b", r"\b(?:don['’]?t|do not)\s+(?:joke|be funny|add humor)\b", r"\bno\s+humou?r\b",
    r"\bkeep\s+it\s+serious\b",
)
TONE = (
    r"\b(?:be|sound|feel|write|respond|talk)(?:\s+to me)?\s+(?:a bit\s+)?(?:more\s+)?(?:conversational|conversationally|friendly|friendlier|warm|warmer|warmly|casual|casually|informal|informally)\b",
    r"\b(?:use|keep|adopt|have)\s+(?:a\s+)?(?:more\s+)?(?:conversational|friendly|friendlier|warm|warmer|casual|informal)\s+tone\b",
    r"\b(?:more\s+)?(?:conversational|friendly|friendlier|warm|warmer|casual|informal)\s+tone\b",
    r"\bless\s+formal\b",
)
ADDRESSING = (
    r"\bcall me\s+[a-z][a-z0-9'_-]*(?:\s+[a-z][a-z0-9'_-]*){0,3}\b", r"\buse my(?:\s+first)?\s+name\b",
    r"\baddress me as\s+[a-z][a-z0-9'_-]*(?:\s+[a-z][a-z0-9'_-]*){0,3}\b", r"\brefer to me as\s+[a-z][a-z0-9'_-]*(?:\s+[a-z][a-z0-9'_-]*){0,3}\b",
)
SERIOUS = (
    r"\bblocker\b", r"\bincident\b", r"\bsev(?:erity)?[-\s]?(?:0|1|2)\b", r"\bproduction\s+(?:issue|incident|outage|bug)\b", r"\boutage\b", r"\bon[-\s]?call\b",
    r"\bsecurity\s+(?:issue|incident|alert|review)\b", r"\bvulnerabilit(?:y|ies)\b", r"\bbreach\b", r"\broot cause\b",
)

# How a turn of talk corrects, tells of a failure, or says that it is mended.
CORRECTIONS = (
    r"^(?:no|nope|nah)\b", r"^not quite\b", r"^(?:that(?:'s| is) wrong|incorrect)\b", r"^(?:actually|instead|rather)\b", r"^(?:still|that still)\b",
    r"^(?:please\s+)?(?:stop|avoid)\b", r"^(?:please\s+)?use\b.+\binstead\b", r"^(?:i asked|i said|i meant|i wanted)\b",
    r"^(?:you missed|you ignored|you changed)\b", r"\bshould be\b", r"\bneeds to\b",
)
CORRECTION_LEADS = (
    r"^(?:no|nope|nah)\b[:\s-]*", r"^not quite\b[:\s-]*", r"^(?:that(?:'s| is) wrong|incorrect)\b[:\s-]*", r"^(?:actually|instead|rather)\b[:\s-]*",
    r"^(?:still|that still)\b[:\s-]*", r"^(?:please\s+)?(?:stop|avoid)\b[:\s-]*", r"^(?:please\s+)?use\b[:\s-]*",
    r"^(?:i asked|i said|i meant|i wanted)\b[:\s-]*", r"^(?:you missed|you ignored|you changed)\b[:\s-]*", r"^[,;:. -]+",
)
FAILURES = (
    r"\b(?:fail(?:ed|ing|ure)?|error(?:ed)?|broken|broke|regress(?:ed|ion)?|crash(?:ed)?|timed?\s*out|timeout|not working|didn'?t work|unable to|could not|cannot|blocked?)\b",
    r"\bmissing\b.{0,30}\b(?:evidence|artifact|output|file|plan|result|context)\b",
)
RESOLUTIONS = (r"\b(?:fixed|resolved|stabilized|passed|green|included|completed|done|working now)\b",)
GOAL = r"\b(?:goal(?:\s+for\s+this\s+session)?\s+is|i(?:\s+am|'m)\s+(?:trying|aiming)\s+to|help me)\s+(.+)$"
MISTAKE = r"\b(?:you keep|you always|again(?:\s+you)?|same mistake|repeating)\b[:\s-]*(.+)$"
FAILURE_GOALS = (
    (r"\b(?:replay|ranking|validation|assert|test)\b", "stabilize failing validation and replay coverage before shipping"),
    (r"\b(?:backfill|rollback|restore|snapshot|schema|migration)\b", "stabilize migration and recovery paths before broader rollout"),
    (r"\b(?:prompt|persona|style|identity|override)\b", "stabilize prompt-shaping and persona behavior before continuing rollout"),
    (r"\b(?:build|lint|typecheck|compile|command|workflow|action)\b", "stabilize failing execution paths before continuing implementation"),
)
OTHER_FAILURE_GOAL = "stabilize repeated failure paths before continuing implementation"
IMPLICIT_MISTAKE = "missing or overriding explicit user corrections before continuing implementation"

# Summaries that tell nothing of the work.
NOISE_SUMMARIES = (
    r"^session [0-9a-f-]{8,}$", r"^worked in .+ \([0-9a-f-]{8,}\)$", r"^call the tool\b", r"\breturn only the tool output\b", r"^using only local repo files\b",
)

# Words that say nothing of a task, greetings, and openings that address nobody.
TASK_STOP_WORDS = (
    "about", "after", "also", "been", "before", "between", "both", "could", "does", "each", "even", "from", "have", "into", "just", "know", "like", "made",
    "make", "many", "most", "much", "must", "need", "only", "other", "over", "same", "some", "still", "such", "take", "than", "that", "their", "them", "then",
    "there", "these", "they", "this", "through", "very", "want", "well", "were", "what", "when", "where", "which", "while", "will", "with", "would", "your",
    "please", "implement", "build", "create", "update", "write", "check", "conversation", "conversations", "continue", "keep", "prior", "consistent",
    "decision", "decisions", "session", "sessions", "history", "apply",
)
PHATIC_TERMS = ("help", "today", "there", "morning", "afternoon", "evening", "thanks", "thank")
NO_ADDRESS = ("hey", "hi", "ok", "okay", "please", "researching", "planning", "implementing", "continue", "update")

# Openings that address somebody before the task is told.
FRAMES = (r"^([a-z][a-z0-9_-]{2,20})[,:]\s+", r"^(?:hi|hello|hey)\s+[a-z][a-z0-9_-]{2,20}(?:[!?,.]\s*|\s+)", r"^(?:hi|hello|hey)[!?,.\s]+")

# How much each property of a planned action adds to its risk.
MUTABILITY = {"read-only": 0, "append-only": 1, "metadata-update": 2, "destructive-write": 4}
REVERSIBILITY = {"reversible": 0, "operator-reversible": 1, "difficult": 2, "irreversible": 4}
REACH = {"isolated": 0, "repository": 1, "workspace": 2, "multi-workspace": 3, "external-system": 4}
TRUST = {"trusted": 0, "constrained": 1, "unknown": 2, "untrusted": 3}

# Requests for a manner of talk, and the signs of each manner.
STYLE_REQUESTS = (
    r"\b(?:talk|speak|respond|reply|sound|be|keep|write|communicate)\b.{0,40}\b(?:to me|with me|more|like|as|tone|voice|style)\b",
    r"\b(?:please|can you|could you|would you|i(?:'d| would)? like|i prefer|i want|it helps when|feel free to)\b.{0,60}\b(?:tone|voice|style|friendly|warm|colleague|coworker|teammate|collaborative|humou?r|joke)\b",
    r"\b(?:let'?s|we should)\b.{0,40}\b(?:solve|work|figure|debug|build)\b.{0,20}\btogether\b",
)
AS_COLLEAGUE = (r"\bcolleague\b", r"\bcoworker\b", r"\bteam(?: |-)?mate\b", r"\bpeer\b")
AS_FRIEND = (r"\bfriendly\b", r"\bwarm\b", r"\bapproachable\b", r"\bconversational\b")
AS_PARTNER = (r"\bcollaborative\b", r"\bcollaborate\b", r"\bwork together\b", r"\bsolve .* together\b", r"\bpartner with me\b")
WITH_HUMOUR = (
    r"\blight(?:-|\s)?humou?r\b", r"\blittle humou?r\b", r"\bbit of humou?r\b", r"\boccasional (?:humou?r|jokes?)\b",
    r"\b(?:use|add|include)\b.{0,20}\b(?:humou?r|jokes?)\b", r"\bfeel free to\b.{0,20}\b(?:humou?r|jokes?)\b",
)
WITHOUT_HUMOUR = (r"\bno jokes?\b", r"\bskip (?:the )?jokes?\b", r"\bwithout (?:the )?humou?r\b", r"\bkeep it serious\b")
BY_NAME = (
    r"\b(?:use|mention|say|include)\s+(?:my\s+)?name\b.{0,30}\b(?:naturally|sparingly|occasionally|when it fits)\b",
    r"\b(?:naturally|sparingly)\b.{0,20}\b(?:use|mention)\b.{0,20}\b(?:my\s+)?name\b",
)
OFTEN_HUMOUR = (r"\b(?:often|frequently|regularly)\b.{0,20}\b(?:humou?r|jokes?)\b",)
PREFERENCE, REJECTION = r"\b(?:always|prefer)\b", r"\b(?:never|do not|don't)\b"
# Beginnings of items that say little, and words of the engine's own subject.
LOW_SIGNAL_ITEMS = (
    "files created", "files modified", "remaining work", "immediate next steps", "diagnostics/validation",
    r"phase \d+ implementation so far intentionally stayed within the approved boundary", "the user asked to start implementing", "the conversation covered",
)
DOMAIN_WORDS = (
    r"\b(?:prompt|shaping|scope|override|audit|backfill|restore|rollback|snapshot|deferred|identity|cross-repo|memory|trace|schema|replay)\b"
)

# What raises and lowers the worth of an outline's line.
OUTLINE_WORDS = (
    r"\b(added|updated|extended|refined|implemented|captured|validated|scope|override|audit|backfill|restore|rollback|snapshot|prompt|identity|cross-repo|schema|trace|replay|deferred|memory|lore)\b"
)
OUTLINE_ACTORS = r"\b(the user|the conversation)\b"
OUTLINE_TITLES = r"^(files created|files modified|remaining work|immediate next steps|diagnostics\/validation|files in scope|implementation order)$"

# How users name themselves, greetings before it, and words that are no names.
USER_NAMES = (r"^i(?:['’]m| am)\s+(.+?)[.!?]*$", r"^my name is\s+(.+?)[.!?]*$", r"^call me\s+(.+?)[.!?]*$")
GREETINGS = (r"^(?:hi|hello|hey)\s+[a-z][a-z0-9_-]{2,20}(?:[!?,.\s-]+|$)", r"^(?:hi|hello|hey)(?:[!?,.\s-]+|$)")
NO_USER_NAMES = ("back", "done", "good", "here", "ok", "okay", "ready", "stuck")

# Terms that a term of a search of raw sessions stands for too.
RAW_ALIASES = {
    "chat": ("conversation", "session"),
    "lore": ("memory", "history", "session"),
    "conversation": ("chat", "session", "history"),
    "conversations": ("chat", "session", "history"),
    "memory": ("remember", "history", "lore"),
    "past": ("history", "prior"),
    "previous": ("history", "prior"),
    "recall": ("memory", "history", "remember"),
    "remember": ("memory", "history", "lore"),
    "remembering": ("memory", "history", "lore"),
    "retrieval": ("memory", "history", "lore"),
    "session": ("conversation", "history"),
}
