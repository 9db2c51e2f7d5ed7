"""Word lists, language tables, patterns, thresholds and weights.

Every value here must stay as it is for results to agree with published ones. All are defaults:
the functions that use them take another table as an argument.
"""

from __future__ import annotations

# --- Fixed values: languages -------------------------------------------------------------------
EXTENSION_LANGUAGE = {
    "py": "Python", "java": "Java", "js": "JavaScript", "cpp": "C++", "c": "C", "go": "Go", "php": "PHP",
    "rb": "Ruby", "cs": "C#", "ts": "TypeScript", "html": "HTML", "css": "CSS", "xml": "XML", "json": "JSON",
    "sh": "Shell", "bat": "Batch", "rs": "Rust", "swift": "Swift", "kt": "Kotlin",
}
# Detection by file name groups TypeScript with JavaScript and knows no CSS.
DETECTED_LANGUAGE = {
    "py": "Python", "js": "JavaScript", "ts": "JavaScript", "java": "Java", "cpp": "C++", "c": "C", "go": "Go",
    "rb": "Ruby", "php": "PHP", "cs": "C#", "html": "HTML", "json": "JSON", "sh": "Shell", "bat": "Batch",
    "rs": "Rust", "swift": "Swift", "kt": "Kotlin", "xml": "XML",
}
# The older, coarser grouping.
LANGUAGE_FAMILY = {
    "py": "python", "js": "javascript", "ts": "javascript", "java": "java", "c": "cpp", "cpp": "cpp", "h": "cpp",
    "go": "go", "rb": "ruby",
}
FAMILY_EXTENSION = {
    "py": ".py", "js": ".js", "ts": ".ts", "java": ".java", "cpp": ".cpp", "h": ".cpp", "go": ".go", "rb": ".rb",
}
BINARY_EXTENSIONS = ["mo", "exe", "dll", "o", "class"]
SOURCE_EXTENSIONS = ["py", "js", "java", "go", "rb", "php", "ts"]
SECURITY_LANGUAGES = ["Python", "JavaScript", "Java", "C++", "Go", "Ruby"]

# --- Fixed values: keywords --------------------------------------------------------------------
LANGUAGE_KEYWORDS = {
    "py": ["def", "class", "import", "return", "if", "else", "elif", "try", "except", "for", "while"],
    "java": ["class", "public", "private", "protected", "void", "int", "if", "else", "try", "catch", "for", "while"],
    "js": ["function", "class", "const", "let", "var", "if", "else", "try", "catch", "for", "while"],
    "ts": ["function", "class", "const", "let", "var", "if", "else", "try", "catch", "for", "while"],
    "go": ["func", "package", "import", "return", "if", "else", "for"],
    "php": ["function", "class", "public", "private", "protected", "return", "if", "else", "for", "while"],
    "cpp": ["int", "void", "class", "public", "private", "protected", "if", "else", "for", "while", "try", "catch"],
}
# The long lists.
PYTHON_RESERVED = [
    "False", "None", "True", "and", "as", "assert", "break", "class", "continue", "def", "del", "elif", "else", "except",
    "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise",
    "return", "try", "while", "with", "yield",
]
LONG_KEYWORDS = {
    "py": PYTHON_RESERVED,
    "java": [
        "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default",
        "do", "double", "else", "enum", "extends", "final", "finally", "float", "for", "goto", "if", "implements", "import",
        "instanceof", "int", "interface", "long", "native", "new", "null", "package", "private", "protected", "public",
        "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient",
        "try", "void", "volatile", "while",
    ],
    "js": [
        "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum",
        "export", "extends", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null", "return",
        "super", "switch", "this", "throw", "try", "true", "false", "undefined", "var", "void", "while", "with", "yield",
    ],
    "ts": [
        "abstract", "any", "as", "asserts", "async", "await", "boolean", "break", "case", "catch", "class", "const",
        "continue", "declare", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for",
        "from", "function", "if", "implements", "import", "in", "infer", "instanceof", "interface", "is", "keyof", "let",
        "module", "namespace", "never", "new", "null", "number", "object", "package", "private", "protected", "public",
        "readonly", "record", "return", "super", "switch", "symbol", "template", "this", "throw", "true", "try", "type",
        "undefined", "union", "unknown", "var", "void", "while", "with", "yield",
    ],
    "go": [
        "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto",
        "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var",
    ],
    "php": [
        "abstract", "and", "array", "as", "break", "callable", "case", "catch", "class", "clone", "const", "continue",
        "declare", "default", "die", "do", "echo", "else", "elseif", "empty", "enddeclare", "endfor", "endforeach", "endif",
        "endswitch", "endwhile", "eval", "exit", "extends", "final", "finally", "for", "foreach", "function", "global",
        "goto", "if", "implements", "include", "include_once", "instanceof", "insteadof", "interface", "isset", "list",
        "namespace", "new", "or", "print", "private", "protected", "public", "require", "require_once", "return", "static",
        "switch", "throw", "trait", "try", "unset", "use", "var", "while", "xor", "yield",
    ],
    "cpp": [
        "alignas", "alignof", "and", "and_eq", "asm", "auto", "bitand", "bitor", "bool", "break", "case", "catch", "char",
        "char16_t", "char32_t", "class", "compl", "concept", "const", "const_cast", "continue", "decltype", "default",
        "delete", "do", "double", "dynamic_cast", "else", "enum", "explicit", "export", "extern", "false", "float", "for",
        "friend", "goto", "if", "inline", "int", "long", "mutable", "namespace", "new", "noexcept", "not", "not_eq",
        "nullptr", "operator", "or", "or_eq", "private", "protected", "public", "register", "reinterpret_cast", "return",
        "short", "signed", "sizeof", "static", "static_assert", "static_cast", "struct", "switch", "template", "this",
        "thread_local", "throw", "true", "try", "typedef", "typeid", "typename", "union", "unsigned", "using", "virtual",
        "void", "volatile", "wchar_t", "while", "xor", "xor_eq",
    ],
}

LABEL_KEYWORDS = {
    "bug": ["bug", "error", "issue", "fix", "crash", "fail", "wrong", "incorrect", "problem"],
    "feature": ["feature", "new", "add", "introduce", "implement", "provide", "create", "integrate"],
    "enhancement": ["enhancement", "improve", "upgrade", "optimize", "better", "expand", "develop", "refine"],
    "documentation": ["doc", "documentation", "comment", "guide", "help", "manual", "describe", "explain"],
}
ISSUE_KEYWORDS = {
    "bug": ["bug", "fix", "error", "issue"],
    "code_smell": ["smell", "cleanup", "refactor", "improve"],
    "security": ["security", "vulnerability", "exploit", "attack"],
}
LABEL_CODES = {"bug": 0, "enhancement": 1, "feature": 2, "documentation": 3}
CODE_METRIC_LABELS = ["bug", "enhancement", "feature"]
CHUNK_CHARS = 500_000

# --- Fixed values: quality rules ---------------------------------------------------------------
LINE_LIMITS = {
    "Python": 79, "JavaScript": 80, "Java": 100, "C++": 100, "Go": 80, "Ruby": 80, "TypeScript": 80, "PHP": 80,
    "Swift": 100, "Kotlin": 100,
}
DEFAULT_LINE_LIMIT = 80
SLASH_COMMENT_LANGUAGES = ["JavaScript", "Java", "C++", "Go", "TypeScript", "PHP", "Swift", "Kotlin"]
CODE_WORDS = ["if", "for", "while", "return", "class", "def", "function"]
DEBUG_PRINTS = {
    "Python": ("print(", "Print statements found."),
    "JavaScript": ("console.log(", "Console.log statements found."),
    "Java": ("System.out.println(", "System.out.println statements found."),
    "C++": ("#include", "Header includes found."),
    "Go": ("fmt.Println(", "fmt.Println statements found."),
    "Ruby": ("puts ", "Put statements found."),
    "TypeScript": ("console.log(", "Console.log statements found."),
    "PHP": ("echo ", "Echo statements found."),
    "Swift": ("print(", "Print statements found."),
    "Kotlin": ("println(", "Println statements found."),
}
COMMENTED_CODE_MESSAGE = "Commented-out code found."
LONG_LINES_MESSAGE = "lines exceed {limit} characters."
NO_ISSUES_MESSAGE = "No major code quality issues found."

METRICS = ["nloc", "avg_nloc", "avg_ccn", "avg_token", "fun_cnt", "warning_cnt", "fun_rt", "nloc_rt"]
# One line per rating; values in the order of METRICS.
RATING_THRESHOLDS = {
    "worst": [1000000, 150, 15, 1000, 400, 1, 1.5, 1.0],
    "bad": [500000, 100, 15, 700, 300, 1, 2.0, 1.5],
    "not bad": [300000, 75, 9.5, 500, 200, 11, 1.5, 1.2],
    "medium": [200000, 50, 6.5, 300, 100, 0, 1.2, 1.0],
    "good": [10000, 40, 4.5, 150, 50, 0, 1.0, 0.8],
    "great": [5000, 30, 2.5, 70, 30, 0, 0.8, 0.6],
    "best": [2000, 20, 1.5, 50, 20, 0, 0.6, 0],
    "the best": [1000, 10, 1, 30, 10, 0, 0, 0],
}
RENAMED_RATINGS = {"not bad": "below average", "medium": "average"}
RATING_MARGIN = 0.1

# --- Fixed values: targets ---------------------------------------------------------------------
CLASSIFICATION_WEIGHTS = {
    "is_bug_fix": 3.0, "merge_status": 2.0, "code_quality_rate": 4.0, "code_quality_issues": 4.0,
}
REGRESSION_WEIGHTS = {
    "files_changed": 2.0, "lines_added": 2.0, "lines_deleted": 2.0, "time_to_merge": 2.0, "num_commits": 2.0,
    "num_comments": 3.0, "num_reviewers": 3.0, "author_experience": 2.0, "review_time": 3.0, "num_approvals": 3.0,
    "review_sentiment_score": 3.0,
}

# --- Fixed values: model notes -----------------------------------------------------------------
INTERPRETABILITY = {
    "RandomForestClassifier": "Medium (feature importance available)",
    "LinearSVC": "Low (complex decision boundaries)",
    "MultilayerPerceptronClassifier": "Low (black-box model)",
}
INTERPRETABILITY_DEFAULT = "Unknown"
