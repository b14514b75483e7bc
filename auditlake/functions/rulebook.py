"""Rule values the audit is defined by.

Everything in this file is a fixed value: lists, labels, patterns and levels
that have to be exactly these for results to be comparable.  Order matters --
several operators are "first rule wins".  No logic lives here.
"""

from __future__ import annotations

LANGUAGE_BY_EXTENSION = {".c": "c", ".h": "c", ".py": "python", ".java": "java"}

# --- fixed values: where untrusted data enters ------------------------------

SOURCES = {
    "c": {
        "function_calls": [
            "gets", "scanf", "read", "recv", "recvfrom", "fgets", "getenv",
            "getcwd", "getwd", "readlink", "realpath",
        ],
        "variables": ["argv", "argc", "environ"],
        "patterns": ["stdin", "cin", "getchar"],
    },
    "python": {
        "function_calls": ["input", "getattr", "__import__", "eval", "exec"],
        "credential_patterns": [
            "password", "passwd", "secret", "api_key", "api_secret", "token",
            "private_key", "access_key",
        ],
        "objects": [
            "request.args", "request.form", "request.json", "request.cookies",
            "request.headers", "request.files", "request.data",
            "request.values", "os.environ", "sys.argv",
        ],
        "patterns": [
            ".read()", ".readlines()", "socket.recv", "urlopen(",
            "requests.get(", "requests.post(",
        ],
    },
    "java": {
        "function_calls": [],
        "objects": [
            "request.getParameter", "request.getQueryString",
            "request.getHeader", "request.getCookies",
            "request.getInputStream", "request.getReader",
            "request.getParameterValues", "request.getParameterMap",
            "System.getenv", "System.getProperty",
        ],
        "patterns": [
            "@RequestParam", "@PathVariable", "@RequestBody",
            "@RequestHeader", "@CookieValue",
        ],
    },
}

# --- fixed values: dangerous operations by category -------------------------

SINKS = {
    "c": {
        "buffer_overflow": [
            "strcpy", "strcat", "sprintf", "memcpy", "gets", "scanf", "wcscpy",
            "wcscat", "swprintf", "_mbscpy", "_mbscat", "lstrcpy", "lstrcat",
            "bcopy", "memmove", "strdup", "strndup",
        ],
        "command_injection": [
            "system", "popen", "execve", "execl", "execvp", "execle", "execlp",
            "execvpe", "CreateProcess", "_exec", "_spawn", "_system", "_popen",
            "ShellExecute", "ShellExecuteEx",
        ],
        "format_string": [
            "printf", "sprintf", "syslog", "vsprintf", "vprintf", "fprintf",
            "snprintf", "dprintf", "vdprintf",
        ],
        "memory_corruption": [
            "memmove", "free", "realloc", "alloca", "memset", "memcmp",
            "_malloca", "_freea",
        ],
        "path_traversal": [
            "fopen", "open", "stat", "access", "chmod", "chown", "realpath",
            "opendir", "readlink", "unlink", "rename", "remove", "mkdir",
            "rmdir", "creat", "openat", "fopen_s",
        ],
        "integer_overflow": ["malloc", "calloc", "realloc", "alloca"],
        "race_condition": ["access", "stat", "fopen", "open"],
    },
    "python": {
        "command_injection": [
            "os.system", "os.popen", "subprocess.call", "subprocess.Popen",
            "subprocess.run", "subprocess.check_output",
            "subprocess.check_call", "os.execv", "os.execve", "os.execl",
            "os.execle", "os.spawnl", "os.spawnv", "os.spawnlp",
            "asyncio.create_subprocess_shell",
        ],
        "code_injection": [
            "eval", "exec", "compile", "__import__", "importlib.import_module",
        ],
        "deserialization": [
            "pickle.loads", "pickle.load", "pickle.Unpickler", "yaml.load",
            "yaml.unsafe_load", "marshal.loads", "dill.loads",
            "jsonpickle.decode", "torch.load",
        ],
        "sql_injection": [
            "cursor.execute", "connection.execute", ".raw(", "RawSQL(",
        ],
        "path_traversal": [
            "os.remove", "os.rename", "os.mkdir", "shutil.copy", "shutil.move",
            "shutil.rmtree", "tarfile.extractall", "zipfile.extractall",
            "open(",
        ],
        "ssrf": [
            "requests.get", "requests.post", "requests.put", "requests.delete",
            "requests.patch", "requests.head", "urllib.request.urlopen",
            "urllib.request.urlretrieve", "httpx.get", "httpx.post",
            "httpx.request", "aiohttp.ClientSession",
        ],
        "xss": ["render_template_string", "Markup(", "html.concat", "Response("],
        "credential_hardcoding": [
            "mysql_connect", "pymysql.connect", "psycopg2.connect",
            "sqlite3.connect", "pyodbc.connect", "cx_Oracle.connect",
            "connect(", "authenticate(", "login(",
        ],
    },
    "java": {
        "sql_injection": [
            "Statement.executeQuery", "Statement.execute",
            "Statement.executeUpdate", "Statement.addBatch",
            "createStatement", "prepareStatement(",
        ],
        "command_injection": [
            "Runtime.exec", "Runtime.getRuntime().exec", "ProcessBuilder(",
            "ProcessBuilder.start",
        ],
        "xss": [
            "response.getWriter().write", "response.getWriter().print",
            "response.getWriter().println", "out.println(", "out.print(",
        ],
        "deserialization": [
            "ObjectInputStream.readObject", "readObject(",
            "XMLDecoder.readObject", "XStream.fromXML", "ObjectInputStream(",
            "readUnshared",
        ],
        "path_traversal": [
            "FileInputStream(", "FileOutputStream(", "FileReader(",
            "FileWriter(", "File(", "Paths.get(", "new FileInputStream",
            "new FileReader",
        ],
        "xxe": [
            "DocumentBuilder.parse", "SAXParser.parse", "XMLReader.parse",
            "SAXReader.read", "DocumentBuilderFactory.newInstance",
            "SAXParserFactory.newInstance",
            "XMLInputFactory.createXMLStreamReader",
        ],
        "ssrf": [
            "URL.openConnection", "URL.openStream", "HttpURLConnection",
            "HttpClient.execute", "RestTemplate.getForObject",
            "RestTemplate.postForObject", "WebClient.create",
        ],
    },
}

# --- fixed values: mitigation patterns (pattern, label), in order ------------

SANITIZERS = {
    "c": [
        (r"if\s*\(.*(?:str)?len\s*\([^)]*\).*?[<>=!]+\s*(?:sizeof|MAX|SIZE|BUFSIZ|LIMIT|BUFFER|LEN)(?![a-zA-Z])", "length_check"),
        (r"if\s*\([^)]*?[<>=!]+\s*(?:\d+|sizeof|MAX|SIZE|BUFSIZ|LIMIT|BUFFER|LEN)(?![a-zA-Z])", "size_guard"),
        (r"if\s*\([^)]*?\b(?:len|size|count|length|n)\b\s*[<>=!]+\s*\d+\s*\)", "numeric_bound"),
        (r"if\s*\(.*\bsizeof\s*\(?[^)]*\)?\s*[<>=!]", "sizeof_bound"),
        (r"snprintf\s*\(", "safe_snprintf"),
        (r"strncpy\s*\(", "safe_strncpy"),
        (r"strncat\s*\(", "safe_strncat"),
        (r"fgets\s*\([^,]+,\s*(?:MAX|SIZE|sizeof|BUFSIZ|LIMIT)", "safe_fgets"),
        (r"if\s*\([^)]*\bNULL\b[^)]*\)", "null_check"),
        (r"if\s*\([^)]*\bptr\s*!=\s*NULL", "null_check_ptr"),
        (r'scanf\s*\(\s*"\%\d+s', "scanf_bounded"),
        (r'printf\s*\(\s*"', "printf_format_literal"),
        (r"if\s*\([^)]*\bNULL\b[^)]*\)\s*\{[^}]*free\s*\(|free\s*\([^)]*\)\s*;\s*\S+\s*=\s*NULL", "safe_free"),
        (r"strchr\s*\([^)]*\)\s*!=\s*NULL", "strchr_null_check"),
        (r"memcpy\s*\([^,]+,\s*[^,]+,\s*sizeof\s*\(", "memcpy_sizeof"),
        (r"strncat\s*\([^,]+,\s*[^,]+,\s*sizeof", "strncat_bounded"),
        (r"snprintf\s*\([^,]+,\s*sizeof", "snprintf_bounded"),
        (r"strtok\s*\([^)]*\).*?\bNULL\b", "token_null_guard"),
        (r"if\s*\(\s*!\s*\w+\s*\)\s*return\s+(?:NULL|0|false)", "ptr_null_guard_early_return"),
        (r"if\s*\(.*[<>=!]+\s*sizeof\s*\(?[^)]*\)?", "sizeof_bound_reverse"),
    ],
    "python": [
        (r"\.strip\(\)|\.lstrip\(\)|\.rstrip\(\)", "strip"),
        (r"re\.(?:sub|escape|match|search|fullmatch)\(", "regex_sanitize"),
        (r"html\.escape\(|markupsafe\.escape\(|cgi\.escape\(", "html_escape"),
        (r"\bint\s*\(|\bfloat\s*\(|\bstr\s*\(|\bbool\s*\(|\blist\s*\(|\bdict\s*\(", "type_cast"),
        (r"shlex\.quote\(|pipes\.quote\(|escape\(.*\)", "shell_escape"),
        (r"cursor\.execute\([^,]+,\s*\(|execute\([^,]+,\s*\[", "parameterized_query"),
        (r"os\.path\.(?:basename|abspath|realpath|normpath|dirname)\(", "path_normalize"),
        (r"yaml\.safe_load\(|json\.loads\(|ast\.literal_eval\(|ast\.parse\(|ast\.walk\(", "safe_parse"),
        (r"ast\.walk\(.*\).*allowed|allowed.*ast\.walk", "safe_eval_ast_whitelist"),
        (r"subprocess\.(?:call|Popen|run)\(\[", "subprocess_list_args"),
        (r"__builtins__\s*=|safe_builtins|safe_globals", "exec_sandbox"),
        (r"if\s+\w+\s+(?:not\s+)?in\s+(?:[\[({]|\w+)", "allowlist_check"),
        (r'[\[{]\s*"[^"]+"(?:\s*,\s*(?:"[^"]+"|\w+))*\s*[\]}]', "command_allowlist"),
        (r"json\.load\(|yaml\.safe_load\(|csv\.reader\(", "safe_read"),
        (r"os\.(?:environ|getenv)\.get\(|os\.environ\[|getenv\(", "env_var_credential"),
    ],
    "java": [
        (r"PreparedStatement", "prepared_statement"),
        (r"\.escapeHtml\(|\.escapeXml\(|StringEscapeUtils\.", "output_encoding"),
        (r"Pattern\.matches\(|\.matches\(.*regex", "input_validation"),
        (r"File\.createTempFile\(|Paths\.get\([^)]*\)\.normalize\(\)", "path_safe"),
        (r"!= null\s*&&|null\s*==", "null_check"),
        (r"try\s*\{|catch\s*\(.*Exception", "exception_handling"),
    ],
}

# --- fixed values: risk per category ----------------------------------------

RISK = {
    "code_injection": "high",
    "command_injection": "high",
    "deserialization": "high",
    "sql_injection": "high",
    "xxe": "high",
    "buffer_overflow": "high",
    "format_string": "medium",
    "ssrf": "medium",
    "xss": "medium",
    "path_traversal": "medium",
    "memory_corruption": "medium",
    "integer_overflow": "medium",
    "race_condition": "medium",
    "credential_hardcoding": "high",
}
RISK_ORDER = {"high": 0, "medium": 1, "low": 2}

# Categories that need no source-to-sink path.
SELF_CONTAINED = ["memory_corruption", "integer_overflow", "credential_hardcoding", "format_string"]

# --- fixed values: mitigations that settle a category -----------------------

STRONG_SIGNALS = {
    "command_injection": ["shell_escape", "subprocess_list_args", "command_allowlist"],
    "sql_injection": ["parameterized_query", "prepared_statement"],
    "code_injection": ["exec_sandbox", "safe_parse", "safe_eval_ast_whitelist"],
    "buffer_overflow": [
        "length_check", "sizeof_bound", "sizeof_bound_reverse", "numeric_bound",
        "size_guard", "safe_strncpy", "safe_strncat", "safe_snprintf",
        "scanf_bounded", "memcpy_sizeof", "strncat_bounded", "snprintf_bounded",
    ],
    "path_traversal": ["path_normalize"],
    "deserialization": ["safe_parse"],
    "format_string": ["printf_format_literal"],
    "credential_hardcoding": ["env_var_credential"],
    "memory_corruption": [
        "null_check", "null_check_ptr", "ptr_null_guard_early_return", "safe_free",
    ],
    "ssrf": ["input_validation"],
    "xss": ["html_escape", "output_encoding"],
    "integer_overflow": [
        "size_guard", "numeric_bound", "length_check", "ptr_null_guard_early_return",
    ],
}
# Labels that count for a category on top of its strong ones.
EXTRA_RELEVANT = {
    "command_injection": ["allowlist_check", "strip", "regex_sanitize"],
    "code_injection": ["allowlist_check"],
    "buffer_overflow": ["null_check", "safe_fgets"],
    "memory_corruption": ["strchr_null_check", "token_null_guard"],
    "integer_overflow": ["null_check"],
}
# The smaller table used by the quick "likely safe" test.
QUICK_SAFE_SIGNALS = {
    "sql_injection": ["parameterized_query", "prepared_statement"],
    "xss": ["html_escape", "output_encoding"],
    "code_injection": ["safe_parse", "ast.literal_eval"],
    "command_injection": ["subprocess_list_args", "shell_escape"],
    "buffer_overflow": ["length_check", "safe_snprintf", "safe_strncpy"],
    "path_traversal": ["path_normalize", "path_safe"],
    "deserialization": ["safe_parse"],
    "ssrf": ["input_validation"],
}

# --- fixed values: tool coverage --------------------------------------------

TOOL_COVERS = {
    "codeslicer": [
        "buffer_overflow", "command_injection", "code_injection", "sql_injection",
        "path_traversal", "format_string", "memory_corruption",
        "integer_overflow", "deserialization", "race_condition",
    ],
    "codeql": [
        "buffer_overflow", "command_injection", "sql_injection",
        "path_traversal", "format_string", "memory_corruption",
        "integer_overflow", "race_condition", "null_dereference",
        "resource_leak",
    ],
    "semgrep": [
        "command_injection", "code_injection", "sql_injection",
        "path_traversal", "deserialization", "cryptography_misuse", "xss",
    ],
}
TOOL_BLIND_SPOTS = {
    "codeslicer": [
        "logic_flaws", "business_logic", "auth_bypass", "cryptography_misuse",
        "configuration",
    ],
    "codeql": ["business_logic", "auth_bypass", "cryptography_misuse"],
    "semgrep": [
        "memory_corruption", "integer_overflow", "race_condition",
        "use_after_free", "double_free",
    ],
}
UNIVERSAL_BLIND_SPOTS = [
    "logic_flaws", "business_logic", "TOCTOU", "cryptography_misuse",
    "integer_overflow",
]
# Tool that is expected for a language and reported as not run when absent.
EXPECTED_TOOL = {"c": "codeql", "python": "semgrep"}

# --- fixed values: vulnerability type -> CWE, in match order -----------------

CWE_BY_TYPE = [
    ("sql injection", "CWE-89"),
    ("sql_injection", "CWE-89"),
    ("command injection", "CWE-78"),
    ("command_injection", "CWE-78"),
    ("os command injection", "CWE-78"),
    ("code injection", "CWE-94"),
    ("code_injection", "CWE-94"),
    ("xss", "CWE-79"),
    ("cross-site scripting", "CWE-79"),
    ("cross site scripting", "CWE-79"),
    ("ldap injection", "CWE-90"),
    ("xpath injection", "CWE-643"),
    ("xml injection", "CWE-91"),
    ("xxe", "CWE-611"),
    ("xml external entity", "CWE-611"),
    ("buffer overflow", "CWE-120"),
    ("buffer_overflow", "CWE-120"),
    ("stack buffer overflow", "CWE-121"),
    ("heap buffer overflow", "CWE-122"),
    ("out-of-bounds read", "CWE-125"),
    ("out-of-bounds write", "CWE-787"),
    ("format string", "CWE-134"),
    ("format_string", "CWE-134"),
    ("use after free", "CWE-416"),
    ("use_after_free", "CWE-416"),
    ("double free", "CWE-415"),
    ("double_free", "CWE-415"),
    ("null pointer", "CWE-476"),
    ("null_pointer_dereference", "CWE-476"),
    ("integer overflow", "CWE-190"),
    ("integer_overflow", "CWE-190"),
    ("path traversal", "CWE-22"),
    ("path_traversal", "CWE-22"),
    ("directory traversal", "CWE-22"),
    ("arbitrary file read", "CWE-22"),
    ("arbitrary file write", "CWE-22"),
    ("hardcoded credentials", "CWE-798"),
    ("hardcoded password", "CWE-798"),
    ("hardcoded key", "CWE-321"),
    ("missing authentication", "CWE-306"),
    ("privilege escalation", "CWE-269"),
    ("weak cryptography", "CWE-327"),
    ("weak encryption", "CWE-327"),
    ("insufficient key size", "CWE-326"),
    ("deserialization", "CWE-502"),
    ("insecure deserialization", "CWE-502"),
    ("unsafe deserialization", "CWE-502"),
    ("ssrf", "CWE-918"),
    ("server-side request forgery", "CWE-918"),
    ("race condition", "CWE-362"),
    ("time of check time of use", "CWE-367"),
    ("toctou", "CWE-367"),
    ("resource exhaustion", "CWE-400"),
    ("denial of service", "CWE-400"),
    ("memory leak", "CWE-401"),
]

# --- fixed values: CWE -> vulnerability type --------------------------------

TYPE_BY_CWE = {
    "CWE-121": "buffer_overflow",
    "CWE-122": "buffer_overflow",
    "CWE-125": "out_of_bounds_read",
    "CWE-787": "out_of_bounds_write",
    "CWE-134": "format_string",
    "CWE-78": "command_injection",
    "CWE-77": "command_injection",
    "CWE-89": "sql_injection",
    "CWE-416": "use_after_free",
    "CWE-415": "double_free",
    "CWE-476": "null_pointer",
    "CWE-190": "integer_overflow",
    "CWE-20": "input_validation",
    "CWE-119": "buffer_overflow",
    "CWE-189": "integer_overflow",
    "CWE-200": "information_disclosure",
    "CWE-362": "race_condition",
    "CWE-399": "resource_exhaustion",
}
# The labelled-CVE table knows one more; the live feeds know six others.
TYPE_BY_CWE_LABELLED = {**TYPE_BY_CWE, "CWE-264": "privilege_escalation"}
TYPE_BY_CWE_FEED = {
    **TYPE_BY_CWE,
    "CWE-22": "path_traversal",
    "CWE-94": "code_injection",
    "CWE-502": "deserialization",
    "CWE-352": "csrf",
    "CWE-918": "ssrf",
    "CWE-79": "xss",
}

# --- fixed values: sink -> reference CWE ------------------------------------

CWE_BY_SINK = {
    "system": "CWE-78",
    "popen": "CWE-78",
    "exec": "CWE-94",
    "eval": "CWE-95",
    "strcpy": "CWE-120",
    "strcat": "CWE-120",
    "sprintf": "CWE-120",
    "gets": "CWE-242",
    "scanf": "CWE-120",
    "memcpy": "CWE-122",
    "free": "CWE-416",
    "malloc": "CWE-789",
    "fopen": "CWE-22",
    "recv": "CWE-120",
    "read": "CWE-120",
}

# --- fixed values: stage-1 skip set, sampling filter, legacy checks ----------

PRIORITY_SINKS = [
    "system", "eval", "exec", "strcpy", "gets", "sprintf", "pickle.loads",
    "pickle.load", "yaml.load", "os.system", "subprocess.Popen",
    "subprocess.call", "Runtime.exec", "ProcessBuilder",
]
SAMPLING_SINK_NAMES = [
    "strcpy", "strcat", "sprintf", "memcpy", "memmove", "gets", "scanf",
    "system", "popen", "execve", "printf", "fprintf", "free", "malloc",
    "calloc", "realloc", "send", "recv", "read", "write", "fopen",
]
ARITHMETIC_RULES = [
    (r"\(\s*\w+\s*\)\s*malloc\s*\(\s*\w+\s*\*\s*sizeof", "malloc_overflow"),
    (r"malloc\s*\(\s*\w+\s*\*\s*\w+\s*\)", "malloc_overflow"),
    (r"calloc\s*\(\s*\w+\s*,\s*\w+\s*\*", "calloc_overflow"),
    (r"realloc\s*\(\s*\w+\s*,\s*\w+\s*\*\s*\w+\s*\)", "realloc_overflow"),
    (r"for\s*\(\s*\w+\s*=\s*\d+\s*;\s*\w+\s*<=\s*\w+\s*;", "loop_overflow"),
    (r"\[\s*\w+\s*\+\s*\w+\s*\]", "array_overflow"),
    (r"sizeof\s*\(\s*\w+\s*\)\s*\*\s*\d+\s*\+\s*\w+", "size_overflow"),
]
DANGEROUS_CALLS = [
    "strcpy", "strcat", "sprintf", "vsprintf", "gets", "scanf", "memcpy",
    "memmove", "printf", "fprintf", "dprintf", "system", "popen",
]

# --- fixed values: wording tests used by calibration -------------------------

VAGUE_WORDS = ["might", "could be", "possibly", "may be"]
OTHER_AREA_WORDS = ["outside", "additional", "blind", "elsewhere", "further", "another", "also found"]

# --- fixed values: wrapper put in front of a lone C function -----------------

C_WRAPPER = (
    "#include <stdio.h>\n#include <stdlib.h>\n#include <string.h>\n"
    "#include <unistd.h>\n#include <fcntl.h>\n#include <stdint.h>\n"
    "#include <stddef.h>\n\n"
)
C_WRAPPER_LINES = 8

# --- fixed values: function-name pattern for C-like definitions --------------

C_DEFINITION = (
    r"(?:^|\n)\s*(?:static\s+)?"
    r"(?:void|int|char|float|double|long|short|unsigned|size_t|ssize_t"
    r"|uint\w*|int\w*|bool|wchar_t|struct\s+\w+|enum\s+\w+"
    r"|SSL\s*\*|BIGNUM\s*\*|BIO\s*\*|EVP_PKEY\s*\*"
    r"|AVFormatContext\s*\*|APR_DECLARE\S*\s*|apr_\w+\s*\*?"
    r")\s+\**\s*(\w+)\s*\("
)
PY_DEFINITION = r"def\s+(\w+)\s*\("

# --- fixed values: parameter presets -----------------------------------------

PRESETS = {
    "v1": {
        "static_decision": {"no_sink": "uncertain", "low_risk_sink": "uncertain", "sanitizer_threshold": 0, "dataflow_required": True},
        "code_window": {"mode": "iris", "simple_max_chars": 1500, "iris_window_lines": 5, "iris_max_chars": 3000, "iris_fallback_chars": 2000},
        "llm": {"mode": "agent_chain", "agent1_enabled": True, "agent1_temperature": 0.0, "agent1_max_tokens": 2048, "agent1_cot": False, "agent1_rag": False,
                "agent2_enabled": True, "agent2_temperature": 0.1, "agent2_max_tokens": 1024, "agent2_bias": "flag_it",
                "agent3_enabled": False, "agent3_temperature": 0.1, "agent3_max_tokens": 512},
        "post_process": {"enable_conflict_arbitration": False, "enable_confidence_calibration": True, "enable_quality_check": True},
        "json_parser": {"mode": "robust"},
    },
    "v2": {
        "static_decision": {"no_sink": "safe", "low_risk_sink": "uncertain", "sanitizer_threshold": 0, "dataflow_required": True},
        "code_window": {"mode": "simple", "simple_max_chars": 1500},
        "llm": {"mode": "multi_temp_voting", "agent1_enabled": True, "agent1_temperature": 0.0, "agent1_max_tokens": 2048,
                "agent2_enabled": True, "agent2_temperature": 0.1, "agent2_max_tokens": 2048, "agent2_bias": "flag_it",
                "voting_temperatures": [0.0, 0.3, 0.7], "voting_weights": {}, "voting_consensus": 2,
                "agent3_enabled": False, "agent3_temperature": 0.1, "agent3_max_tokens": 512},
        "post_process": {"enable_conflict_arbitration": False, "enable_confidence_calibration": True, "enable_quality_check": True},
        "json_parser": {"mode": "simple"},
    },
    "v3": {
        "static_decision": {"no_sink": "safe", "low_risk_sink": "safe", "sanitizer_threshold": 2, "dataflow_required": True},
        "code_window": {"mode": "dynamic", "simple_max_chars": 3000, "dynamic_iris_lines": 5, "dynamic_medium_chars": 3000},
        "llm": {"mode": "single_pass", "single_pass_temperature": 0.3, "single_pass_max_tokens": 2048},
        "post_process": {"enable_conflict_arbitration": False, "enable_confidence_calibration": True, "enable_quality_check": True},
        "json_parser": {"mode": "robust"},
    },
    "v4": {
        "static_decision": {"no_sink": "uncertain", "low_risk_sink": "uncertain", "sanitizer_threshold": 0, "dataflow_required": False},
        "code_window": {"mode": "dynamic", "simple_max_chars": 3000, "dynamic_iris_lines": 5, "dynamic_medium_chars": 3000},
        "llm": {"mode": "tool_aware_chain", "agent1_enabled": True, "agent1_temperature": 0.0, "agent1_max_tokens": 1024,
                "agent2_enabled": True, "agent2_temperature": 0.1, "agent2_max_tokens": 1024, "agent2_bias": "confirm_it",
                "agent3_enabled": True, "agent3_temperature": 0.1, "agent3_max_tokens": 512, "enable_rag": True},
        "post_process": {"enable_conflict_arbitration": True, "enable_confidence_calibration": True, "enable_quality_check": True},
        "json_parser": {"mode": "robust"},
    },
}
