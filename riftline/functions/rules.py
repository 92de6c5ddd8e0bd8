"""The catalog of line rules, file rules, controls and packs."""

from __future__ import annotations

from dataclasses import dataclass

AST_LANGUAGES = ("javascript", "typescript")


@dataclass(frozen=True)
class Pattern:
    """A pattern in the rules' own dialect; ``plain`` and ``unless`` say the same without lookaround."""

    text: str
    ignore_case: bool = False
    plain: str | None = None
    unless: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    tier: str
    title: str
    patterns: tuple[Pattern, ...]
    blocking: bool = False
    languages: tuple[str, ...] = ("*",)
    raw: bool = False
    skip_if_ast: bool = False
    secret: bool = False

    def applies(self, language: str) -> bool:
        return ("*" in self.languages or language in self.languages) and not (self.skip_if_ast and language in AST_LANGUAGES)


def _cs(*texts: str) -> tuple[Pattern, ...]:
    return tuple(Pattern(t) for t in texts)


def _ci(*texts: str) -> tuple[Pattern, ...]:
    return tuple(Pattern(t, True) for t in texts)


#: The patterns and tiers of the built-in rules, in their order. Titles are our own.
RULES = (
    Rule("hardcoded-secret", "orange", "Hardcoded secret", (
        *_cs(r"\bAKIA[0-9A-Z]{16}\b", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", r"\bghp_[A-Za-z0-9]{36}\b", r"\bgithub_pat_[A-Za-z0-9_]{40,}\b", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", r"\bAIza[0-9A-Za-z_\-]{35}\b", r"\bsk_live_[0-9a-zA-Z]{16,}\b"),
        *_ci(r"""(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key|client[_-]?secret)["']?\s*[:=]\s*["'][^"'\s]{8,}["']"""),
    ), blocking=True, raw=True, secret=True),
    Rule("db-schema-destructive", "orange", "Destructive schema change", (
        *_ci(r"\bDROP\s+(?:TABLE|COLUMN|DATABASE|INDEX|SCHEMA)\b", r"\bTRUNCATE\s+(?:TABLE\s+)?\w"),
        Pattern(r"\bDELETE\s+FROM\b(?![\s\S]*\bWHERE\b)", True, r"\bDELETE\s+FROM\b", r"\bDELETE\s+FROM\b[\s\S]*\bWHERE\b"),
    ), blocking=True),
    Rule("db-schema-change", "orange", "Schema change", _ci(r"\b(?:ALTER|CREATE)\s+TABLE\b", r"\bADD\s+COLUMN\b", r"\bRENAME\s+(?:TABLE|COLUMN|TO)\b")),
    Rule("raw-query", "yellow", "Raw query", _ci(r"\b(?:db|knex|prisma|sequelize|pool|client|conn|cursor|session)\.(?:query|raw|execute|exec)\s*\(", r"\bINSERT\s+INTO\b", r"\bUPDATE\b[^\n]*\bSET\b")),
    Rule("auth-crypto", "orange", "Authentication or cryptography", (
        *_ci(r"\b(?:passport|jsonwebtoken|bcrypt|argon2|scrypt|oauth2?)\b", r"\bjwt\.(?:sign|verify|decode)\b"),
        *_cs(r"\bcrypto\.(?:createHash|createHmac|createCipheriv|pbkdf2|randomBytes)\b", r"\b(?:sign|verify)Token\b"),
        *_ci(r"\b(?:hash|compare)Password\b"), *_cs(r"\b(?:authenticate|authorize|checkPermission|requireAuth|isAdmin)\b"),
    )),
    Rule("dangerous-exec", "orange", "Dynamic code or process execution", _cs(
        r"\beval\s*\(", r"\bnew\s+Function\s*\(", r"\bchild_process\b", r"\.exec(?:Sync|File|FileSync)?\s*\(", r"\bspawn(?:Sync)?\s*\(",
        r"\b(?:os\.system|subprocess\.(?:run|call|Popen|check_output)|pickle\.loads|yaml\.load|__import__)\s*\(",
    )),
    Rule("leftover-debugger", "yellow", "Leftover debugger", _cs(r"\bdebugger\s*;?"), languages=AST_LANGUAGES),
    Rule("network-call", "yellow", "Network call", _cs(r"\b(?:fetch|axios|got|superagent|XMLHttpRequest)\s*\(", r"\brequests\.(?:get|post|put|delete|patch)\s*\(", r"\bhttp\.(?:get|post|request)\s*\(", r"\burllib\.request\b")),
    Rule("debug-logging", "green", "Debug logging", _cs(r"\bconsole\.(?:log|debug|info|warn|error)\s*\(", r"\bSystem\.out\.print", r"\bfmt\.Print")),
    Rule("todo-marker", "green", "Open marker", _cs(r"\b(?:TODO|FIXME|HACK|XXX)\b"), raw=True),
    Rule("sql-injection", "orange", "SQL injection", _ci(
        r"\b(?:db|pool|conn|client|knex|sequelize|cursor|session)\.(?:query|raw|execute|exec)\s*\(\s*`[^`]*\$\{",
        r"""\b(?:db|pool|conn|client|knex|sequelize|cursor|session)\.(?:query|raw|execute|exec)\s*\(\s*["'][^"']*["']\s*\+""",
        r"`\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b[^`]*\$\{(?:req|request|ctx|context)\.",
        r"""["'](?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']\s*\+\s*(?:req|request|ctx)\.""",
    ), blocking=True, skip_if_ast=True),
    Rule("permissive-cors", "orange", "Permissive CORS", (
        *_ci(r"""\bcors\s*\(\s*\{[^}]*\borigin\s*:\s*['"`]\*['"`]""", r"\bcors\s*\(\s*(?:\{\s*\})?\s*\)"),
        *_cs(r"""\borigin\s*:\s*['"`]\*['"`]""", r"""['"]Access-Control-Allow-Origin['"]\s*[,)]\s*['"`]\*['"`]"""),
        *_cs(r"""\.setHeader\s*\(\s*['"]Access-Control-Allow-Origin['"]\s*,\s*['"`]\*['"`]\)"""),
    )),
    Rule("path-traversal", "orange", "Path traversal", _ci(
        r"\bpath\.(?:join|resolve|normalize)\s*\([^)]*(?:req|request|ctx)\.(?:params|query|body)\b", r"\bfs\.(?:readFile|readFileSync|createReadStream|open|openSync)\s*\([^)]*(?:req|request|ctx)\.(?:params|query|body)\b",
        r"(?:__dirname|process\.cwd\(\))\s*,\s*(?:req|request|ctx)\.(?:params|query|body)\b",
    ), skip_if_ast=True),
    Rule("nosql-injection", "orange", "NoSQL injection", (
        *_cs(r"\$where\s*:"), *_ci(r"\bdb\.eval\s*\("),
        Pattern(r"""\.mapReduce\s*\(\s*(?!['"]function)""", True, r"\.mapReduce\s*\(", r"""\.mapReduce\s*\(\s*['"]function"""),
        *_ci(r"\.find(?:One)?\s*\(\s*(?:req|request|ctx)\.(?:body|query|params)\s*[,)]"),
    )),
    Rule("prototype-pollution", "orange", "Prototype pollution", (
        Pattern(r"\bObject\.assign\s*\(\s*(?!\s*\{[^}]*\})[^,)]+,\s*(?:req|request|ctx)\.(?:body|query|params)\b", True, r"\bObject\.assign\s*\(\s*[^,)]+,\s*(?:req|request|ctx)\.(?:body|query|params)\b", r"\bObject\.assign\s*\(\s*\{[^}]*\}"),
        *_ci(r"\b(?:_\.merge|lodash\.merge)\s*\([^,)]+,\s*(?:req|request|ctx)\.(?:body|query|params)\b", r"\b(?:this\.\w+|[a-zA-Z_$][\w$]*(?:\[.*?\]|\.\w+)+)\s*=\s*\{\s*\.\.\.(?:req|request|ctx)\.(?:body|query|params)\b"),
    ), languages=AST_LANGUAGES),
)

#: Words of which each match of a rule holds one, in lower case: lines without any are never matched.
WORDS = {
    "hardcoded-secret": ("akia", "begin", "ghp_", "github_pat_", "xox", "aiza", "sk_live_", "key", "secret", "token", "password", "passwd", "pwd"),
    "db-schema-destructive": ("drop", "truncate", "delete"), "db-schema-change": ("table", "column", "rename"), "raw-query": (".query", ".raw", ".exec", "insert", "update"),
    "auth-crypto": ("passport", "jsonwebtoken", "bcrypt", "argon2", "scrypt", "oauth", "jwt.", "crypto.", "token", "password", "authenticate", "authorize", "checkpermission", "requireauth", "isadmin"),
    "dangerous-exec": ("eval", "function", "child_process", ".exec", "spawn", "os.system", "subprocess", "pickle", "yaml", "__import__"), "leftover-debugger": ("debugger",),
    "network-call": ("fetch", "axios", "got", "superagent", "xmlhttprequest", "requests", "http.", "urllib"), "debug-logging": ("console.", "system.out", "fmt."), "todo-marker": ("todo", "fixme", "hack", "xxx"),
    "sql-injection": (".query", ".raw", ".exec", "req", "ctx", "context"), "permissive-cors": ("cors", "origin"), "path-traversal": ("path.", "fs.", "__dirname", "process.cwd"),
    "nosql-injection": ("$where", "db.eval", "mapreduce", ".find"), "prototype-pollution": ("assign", "merge", "..."),
}

#: Rules on syntax trees: place in the order of all rules, and tier, blocking and title. A name after "/" tells forms of a rule apart.
TREE_RULES = {
    "public-api-change": (20, ("orange", False, "Public interface change")), "sql-injection": (21, ("orange", True, "SQL injection")), "xss-sink": (22, ("orange", False, "HTML injection")),
    "path-traversal": (23, ("orange", False, "Path traversal")), "prototype-pollution/merge": (24, ("orange", False, "Prototype pollution")), "deprecated-api": (25, ("yellow", False, "Deprecated interface")),
    "signature-drift": (26, ("orange", False, "Exported signature changed")),
}
MESSAGES = {
    "hardcoded-secret": "A credential seems to be committed: move it out of the code and replace it.", "db-schema-destructive": "This can delete data: try it on a copy and have a way back.",
    "db-schema-change": "Schema change: check that readers and writers of before still work.", "raw-query": "Raw query: pass values as parameters.", "auth-crypto": "Security code: ask for a second reader and keep its tests.",
    "dangerous-exec": "Runs code or a process from text: make sure that no outside input gets in.", "leftover-debugger": "Remove this stop for debugging tools.", "network-call": "Call over the network: check host, time limit, repeats and errors.",
    "debug-logging": "Logging: take out what was for debugging only.", "todo-marker": "Open work: make sure that it is tracked.", "sql-injection": "SQL is put together from parts that are not constant: use parameters.",
    "sql-injection/passed": "Data of a request is passed as a query.", "permissive-cors": "Any origin may call this: name the origins that are trusted.", "xss-sink": "Text that is not constant becomes HTML: write it as text, or sanitize it.",
    "path-traversal": "A path holds data of a request: resolve it and check that it stays in its folder.", "nosql-injection": "A query may take operators from outside: build it from single checked fields.",
    "prototype-pollution": "Request data is merged into an object: accept known keys only.", "prototype-pollution/merge": "This function merges any key, also `__proto__`, `constructor` and `prototype`: reject those.",
    "public-api-change": "An exported name changes: check who imports it.", "migration-file": "Migration: check that it can be undone and runs in order.", "dependency-manifest": "Dependencies change: check licences and origin of packages.",
}

#: Rules on whole files, as (rule, tier, title).
FILE_RULES = (("migration-file", "orange", "Database migration file"), ("dependency-manifest", "yellow", "Dependency manifest change"))
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "gemfile", "pom.xml", "build.gradle", "cargo.toml", "composer.json")

#: Controls that a rule gives evidence for.
CONTROLS = {
    "hardcoded-secret": ("CC6.1", "CC6.7"), "db-schema-destructive": ("CC8.1", "CC7.1"), "db-schema-change": ("CC8.1",), "migration-file": ("CC8.1",),
    "sql-injection": ("CC6.6", "CC7.1"), "nosql-injection": ("CC6.6", "CC7.1"), "xss-sink": ("CC6.6", "CC7.1"), "path-traversal": ("CC6.6", "CC7.1"),
    "prototype-pollution": ("CC6.6", "CC7.1"), "permissive-cors": ("CC6.6",), "auth-crypto": ("CC6.1",), "dangerous-exec": ("CC6.8", "CC7.1"),
    "public-api-change": ("CC8.1",), "signature-drift": ("CC8.1",), "dependency-manifest": ("CC6.8", "CC7.1"), "deprecated-api": ("CC8.1",),
}
#: Rules with a taint verdict, rules whose tier follows callers, rules that stay as they are in tests, advisory rules.
SECURITY = ("sql-injection", "nosql-injection", "xss-sink", "path-traversal", "dangerous-exec", "prototype-pollution")
CALLER_TIERED = ("public-api-change", "signature-drift")
TEST_EXEMPT = ("hardcoded-secret", "db-schema-destructive", "public-api-change", "signature-drift", "deprecated-api")
ADVISORY = ("auth-crypto", "db-schema-destructive", "dangerous-exec")

#: Language of each file extension.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".py": "python", ".go": "go", ".java": "java", ".rb": "ruby", ".php": "php", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp",
    ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".yml": "yaml", ".yaml": "yaml", ".tf": "terraform", ".json": "json",
}
