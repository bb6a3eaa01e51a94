"""The built-in security rules."""

from __future__ import annotations

_INJECTION = "A03:2021 - Injection"
_CRYPTO = "A02:2021 - Cryptographic Failures"
_CONFIG = "A05:2021 - Security Misconfiguration"
_INTEGRITY = "A08:2021 - Software and Data Integrity Failures"
_ACCESS = "A01:2021 - Broken Access Control"

# Id, severity, language, cwe, owasp, category, tags and pattern
# of every rule, in pack order.  Names, descriptions, messages and remediation
# texts are our own.
RULES: list[dict] = [
    # Python
    dict(
        id="python-sql-injection",
        severity="CRITICAL",
        language="python",
        cwe="CWE-89",
        owasp=_INJECTION,
        category="injection",
        tags=["sql", "injection", "database"],
        pattern=r"""(execute|executemany|cursor\.execute)\s*\(\s*["'].*\%s.*["'].*\%\s*""",
        name="SQL built by string formatting",
        description="A query text is assembled with the % operator before it is executed",
        message_template="Query text is built by string formatting; bind the values as parameters.",
        remediation="Leave the statement's text alone and let the driver bind what varies.",
        references=[
            "https://owasp.org/www-project-top-ten/2017/A1_2017-Injection",
            "https://cheatsheetseries.owasp.org/cheatsheets/SQL_Injection_Prevention_Cheat_Sheet.html",
        ],
    ),
    dict(
        id="python-command-injection-os-system",
        severity="CRITICAL",
        language="python",
        cwe="CWE-78",
        owasp=_INJECTION,
        category="injection",
        tags=["command-injection", "os", "shell"],
        pattern=r"os\.system\s*\(",
        name="Shell command through os.system()",
        description="os.system() hands its text to a shell, which interprets anything a caller put in it",
        message_template="os.system() runs its argument in a shell",
        remediation="Look for a function of the standard library that does the same; if a program must run, fix its name in the code.",
        references=["https://owasp.org/www-community/attacks/Command_Injection"],
    ),
    dict(
        id="python-command-injection-subprocess-shell",
        severity="HIGH",
        language="python",
        cwe="CWE-78",
        owasp=_INJECTION,
        category="injection",
        tags=["command-injection", "subprocess", "shell"],
        pattern=r"subprocess\.(run|call|Popen).*shell\s*=\s*True",
        name="subprocess with a shell",
        description="A subprocess is started through a shell",
        message_template="shell=True lets the shell interpret the command text",
        remediation="Without a shell there is nothing to inject into: hand over program and arguments as separate items.",
    ),
    dict(
        id="python-eval-usage",
        severity="CRITICAL",
        language="python",
        cwe="CWE-95",
        owasp=_INJECTION,
        category="injection",
        tags=["eval", "code-injection"],
        pattern=r"\beval\s*\(",
        name="Call of eval()",
        description="eval() runs whatever expression it is given",
        message_template="eval() executes its argument as code",
        remediation="Decide which values are legal and write, or pick, a parser for just those.",
    ),
    dict(
        id="python-exec-usage",
        severity="CRITICAL",
        language="python",
        cwe="CWE-95",
        owasp=_INJECTION,
        category="injection",
        tags=["exec", "code-injection"],
        pattern=r"\bexec\s*\(",
        name="Call of exec()",
        description="exec() runs whatever statements it is given",
        message_template="exec() executes its argument as code",
    ),
    dict(
        id="python-pickle-unsafe",
        severity="CRITICAL",
        language="python",
        cwe="CWE-502",
        owasp=_INTEGRITY,
        category="deserialization",
        tags=["pickle", "deserialization"],
        pattern=r"pickle\.(loads|load)\s*\(",
        name="Unpickling",
        description="Loading a pickle can run code chosen by whoever wrote it",
        message_template="Unpickling untrusted bytes can run code",
        remediation="Restore data from a format that describes values only, or verify an authentication code before loading.",
    ),
    dict(
        id="python-path-traversal",
        severity="HIGH",
        language="python",
        cwe="CWE-22",
        owasp=_ACCESS,
        category="path-traversal",
        tags=["path-traversal", "file-access"],
        pattern=r"open\s*\([^\)]*[\+].*\)",
        name="Path joined by concatenation",
        description="A file is opened under a path put together with +",
        message_template="The opened path is concatenated and may leave its folder",
        remediation="Compare the canonical form of the path with the permitted root before opening.",
    ),
    dict(
        id="python-weak-hash-md5",
        severity="HIGH",
        language="python",
        cwe="CWE-327",
        owasp=_CRYPTO,
        category="crypto",
        tags=["md5", "weak-crypto"],
        pattern=r"hashlib\.md5\s*\(",
        name="MD5 digest",
        description="MD5 collisions are cheap to produce",
        message_template="MD5 does not protect integrity",
        remediation="Any digest of the SHA-2 or SHA-3 family will do.",
    ),
    dict(
        id="python-weak-hash-sha1",
        severity="MEDIUM",
        language="python",
        cwe="CWE-327",
        owasp=_CRYPTO,
        category="crypto",
        tags=["sha1", "weak-crypto"],
        pattern=r"hashlib\.sha1\s*\(",
        name="SHA-1 digest",
        description="SHA-1 collisions have been shown in practice",
        message_template="SHA-1 is no longer collision resistant",
    ),
    dict(
        id="python-weak-random",
        severity="MEDIUM",
        language="python",
        cwe="CWE-330",
        owasp=_CRYPTO,
        category="crypto",
        tags=["random", "crypto"],
        pattern=r"random\.(random|randint|choice|shuffle)\s*\(",
        name="Predictable random numbers",
        description="The random module is predictable from its output",
        message_template="Values from the random module can be predicted",
        remediation="For tokens and keys, ask the operating system's generator.",
    ),
    dict(
        id="python-flask-debug-true",
        severity="HIGH",
        language="python",
        cwe="CWE-489",
        owasp=_CONFIG,
        category="configuration",
        tags=["flask", "debug", "misconfiguration"],
        pattern=r"app\.run\s*\([^\)]*debug\s*=\s*True",
        name="Flask debugger on",
        description="The Flask debugger shows internals and runs code from the browser",
        message_template="The application starts with its debugger on",
        remediation="Let the deployment's configuration decide, with the debugger off as its default.",
    ),
    dict(
        id="python-django-debug-true",
        severity="HIGH",
        language="python",
        cwe="CWE-489",
        owasp=_CONFIG,
        category="configuration",
        tags=["django", "debug"],
        pattern=r"DEBUG\s*=\s*True",
        name="Django debug setting on",
        description="Django settings with DEBUG switched on",
    ),
    dict(
        id="python-yaml-unsafe-load",
        severity="HIGH",
        language="python",
        cwe="CWE-502",
        owasp=_INTEGRITY,
        category="deserialization",
        tags=["yaml", "deserialization"],
        pattern=r"yaml\.load\s*\([^,)]*\)",
        name="yaml.load() without a loader",
        description="Without a safe loader, YAML can build arbitrary objects",
        message_template="yaml.load() without a loader can build arbitrary objects; use safe_load()",
    ),
    # JavaScript
    dict(
        id="javascript-xss-innerhtml",
        severity="HIGH",
        language="javascript",
        cwe="CWE-79",
        owasp=_INJECTION,
        category="xss",
        tags=["xss", "dom"],
        pattern=r"""\.innerHTML\s*=\s*(?!["'])""",
        name="Markup assigned to innerHTML",
        description="A computed value is assigned to innerHTML",
        message_template="A computed value reaches innerHTML unescaped",
        remediation="Write text as text; where markup is wanted, run it through an allow-list of elements.",
        references=[
            "https://cheatsheetseries.owasp.org/cheatsheets/Cross_Site_Scripting_Prevention_Cheat_Sheet.html"
        ],
    ),
    dict(
        id="javascript-xss-document-write",
        severity="HIGH",
        language="javascript",
        cwe="CWE-79",
        owasp=_INJECTION,
        category="xss",
        tags=["xss", "dom"],
        pattern=r"document\.write\s*\(",
        name="document.write()",
        description="document.write() inserts its text as markup",
        message_template="document.write() inserts unescaped markup",
    ),
    dict(
        id="javascript-xss-eval",
        severity="CRITICAL",
        language="javascript",
        cwe="CWE-95",
        owasp=_INJECTION,
        category="injection",
        tags=["eval", "code-injection"],
        pattern=r"\beval\s*\(",
        name="eval() in a script",
        description="eval() runs whatever script text it is given",
        message_template="eval() executes its argument as script",
        remediation="Data needs a data parser; behaviour belongs in functions.",
    ),
    dict(
        id="javascript-sql-injection",
        severity="CRITICAL",
        language="javascript",
        cwe="CWE-89",
        owasp=_INJECTION,
        category="injection",
        tags=["sql", "injection"],
        pattern=r"""(query|execute)\s*\(\s*[`"].*\$\{.*\}.*[`"]""",
        name="SQL in a template literal",
        description="A query text interpolates values",
        message_template="The query text interpolates values",
        remediation="Prepared statements keep the values out of the grammar.",
    ),
    dict(
        id="javascript-command-injection",
        severity="CRITICAL",
        language="javascript",
        cwe="CWE-78",
        owasp=_INJECTION,
        category="injection",
        tags=["command-injection"],
        pattern=r"(exec|spawn|execSync|execFile)\s*\([^)]*\$\{",
        name="Command in a template literal",
        description="A command text interpolates values",
        message_template="The command text interpolates values",
        remediation="Start the program directly, each argument an element of its own.",
    ),
    dict(
        id="javascript-weak-hash-md5",
        severity="HIGH",
        language="javascript",
        cwe="CWE-327",
        owasp=_CRYPTO,
        category="crypto",
        tags=["md5", "weak-crypto"],
        pattern=r"""createHash\s*\(\s*["']md5["']""",
        name="MD5 digest in Node",
        description="MD5 collisions are cheap to produce",
        message_template="MD5 does not protect integrity",
        remediation="Name a member of the SHA-2 family here.",
    ),
    dict(
        id="javascript-weak-random",
        severity="MEDIUM",
        language="javascript",
        cwe="CWE-330",
        owasp=_CRYPTO,
        category="crypto",
        tags=["random"],
        pattern=r"Math\.random\s*\(",
        name="Math.random() as a secret",
        description="Math.random() is predictable",
        message_template="Math.random() can be predicted; draw secrets from crypto.randomBytes()",
    ),
    dict(
        id="javascript-regex-dos",
        severity="MEDIUM",
        language="javascript",
        cwe="CWE-400",
        owasp=_CONFIG,
        category="dos",
        tags=["regex", "dos"],
        pattern=r"new RegExp\([^)]*(\+\*|\*\+|\*\{)",
        name="Nested quantifiers",
        description="Nested quantifiers can take exponential time",
        message_template="This expression may backtrack without end",
    ),
    dict(
        id="javascript-prototype-pollution",
        severity="HIGH",
        language="javascript",
        cwe="CWE-1321",
        owasp=_INTEGRITY,
        category="injection",
        tags=["prototype-pollution"],
        pattern=r"__proto__\s*[=\[]",
        name="Write to __proto__",
        description="Writing through __proto__ changes every object",
        message_template="A write through __proto__ changes every object",
    ),
    dict(
        id="javascript-path-traversal",
        severity="HIGH",
        language="javascript",
        cwe="CWE-22",
        owasp=_ACCESS,
        category="path-traversal",
        tags=["path-traversal"],
        pattern=r"fs\.(readFile|readFileSync|writeFile)\s*\([^)]*req\.",
        name="Path taken from a request",
        description="A file is accessed under a path from the request",
        message_template="The accessed path comes from the request",
    ),
    dict(
        id="javascript-cors-misconfiguration",
        severity="MEDIUM",
        language="javascript",
        cwe="CWE-346",
        owasp=_CONFIG,
        category="cors",
        tags=["cors", "misconfiguration"],
        pattern=r"Access-Control-Allow-Origin.*\*",
        name="CORS open to all",
        description="Every origin is allowed to read the response",
        message_template="Every origin may read this response",
    ),
    dict(
        id="javascript-jwt-no-verify",
        severity="HIGH",
        language="javascript",
        cwe="CWE-347",
        owasp=_CRYPTO,
        category="jwt",
        tags=["jwt", "authentication"],
        pattern=r"jwt\.decode\s*\([^,)]*\)",
        name="Token read without verification",
        description="A token is decoded and its signature left unchecked",
        message_template="The signature of the token is not checked",
        remediation="Reject tokens whose signature and algorithm have not been checked against the expected key.",
    ),
    # Cross-language pack, web applications
    dict(
        id="owasp-a01-injection-sql-py",
        severity="CRITICAL",
        language="python",
        cwe="CWE-89",
        owasp="A03:2021-Injection",
        category="security",
        tags=["owasp", "injection", "sql"],
        pattern=r"""(execute|cursor\.execute|executemany)\s*\(\s*f?["'].*\{.*\}""",
        name="SQL in an f-string",
        description="The query text interpolates values in braces.",
        remediation="Braces belong in messages; in a statement, mark the spot and supply the value at execution.",
    ),
    dict(
        id="owasp-a01-injection-cmd-py",
        severity="CRITICAL",
        language="python",
        cwe="CWE-78",
        owasp="A03:2021-Injection",
        category="security",
        tags=["owasp", "injection", "command"],
        pattern=r"""(os\.system|subprocess\.call|subprocess\.Popen)\s*\(\s*f?["'].*\{.*\}.*shell\s*=\s*True""",
        name="Interpolated shell command",
        description="A command with interpolated values goes to a shell.",
        remediation="Turn the interpreter off, then check each argument against what the program may be asked to do.",
    ),
    dict(
        id="owasp-a02-broken-auth-hardcoded-py",
        severity="HIGH",
        language="python",
        cwe="CWE-798",
        owasp="A07:2021-Identification and Authentication Failures",
        category="security",
        tags=["owasp", "auth", "credentials"],
        pattern=r"""(?i)(password|secret|apikey|token)\s*=\s*["'][a-zA-Z0-9_\-]{8,}["']""",
        name="Credential in the source",
        description="A password, key or token is written into the source.",
        remediation="Revoke the value, since the history keeps it, and inject its successor at deployment.",
    ),
    dict(
        id="owasp-a01-injection-sql-js",
        severity="CRITICAL",
        language="javascript",
        cwe="CWE-89",
        owasp="A03:2021-Injection",
        category="security",
        tags=["owasp", "injection", "sql"],
        pattern=r"query\s*\(\s*`.*\{.*\}`",
        name="SQL in a Node template literal",
        description="The query text of a Node call interpolates values.",
        remediation="Number the variables in the statement and list them in the call.",
    ),
    dict(
        id="owasp-a03-xss-js",
        severity="HIGH",
        language="javascript",
        cwe="CWE-79",
        owasp="A03:2021-Injection",
        category="security",
        tags=["owasp", "xss"],
        pattern=r"dangerouslySetInnerHTML|innerHTML\s*=",
        name="Raw markup in the page",
        description="Markup is set on an element without escaping.",
        remediation="Let the framework encode; review every exception by hand.",
    ),
    dict(
        id="owasp-a05-security-misconfig-debug-py",
        severity="MEDIUM",
        language="python",
        cwe="CWE-489",
        owasp="A05:2021-Security Misconfiguration",
        category="security",
        tags=["owasp", "configuration"],
        pattern=r"DEBUG\s*=\s*True",
        name="Debug setting on",
        description="The web framework runs in debug mode.",
        remediation="Ship hardened settings by default and have tests assert them.",
    ),
    dict(
        id="owasp-a07-auth-failure-weak-hash-py",
        severity="MEDIUM",
        language="python",
        cwe="CWE-328",
        owasp="A02:2021-Cryptographic Failures",
        category="security",
        tags=["owasp", "crypto"],
        pattern=r"hashlib\.(md5|sha1)\(",
        name="Weak digest",
        description="A broken digest, MD5 or SHA-1, is computed.",
        remediation="Passwords want a slow, salted scheme such as Argon2id; other data a modern digest.",
    ),
    dict(
        id="owasp-a04-insecure-design-pickle-py",
        severity="CRITICAL",
        language="python",
        cwe="CWE-502",
        owasp="A08:2021-Software and Data Integrity Failures",
        category="security",
        tags=["owasp", "deserialization"],
        pattern=r"pickle\.loads?\(",
        name="Pickle as an input format",
        description="A pickle is read, and reading it can run code.",
        remediation="Define a schema for what comes in and read it with a decoder that creates no objects.",
    ),
    dict(
        id="owasp-a01-injection-sql-java",
        severity="CRITICAL",
        language="java",
        cwe="CWE-89",
        owasp="A03:2021-Injection",
        category="security",
        tags=["owasp", "injection", "sql"],
        pattern=r"""(createStatement|prepareStatement)\s*\(\s*["'].*\+\s*[a-zA-Z0-9_]+\s*\+""",
        name="Concatenated JDBC statement",
        description="The text of a JDBC statement is concatenated.",
        remediation="Set the variables through the statement's typed setters.",
    ),
    dict(
        id="owasp-a02-broken-auth-hardcoded-java",
        severity="HIGH",
        language="java",
        cwe="CWE-798",
        owasp="A07:2021-Identification and Authentication Failures",
        category="security",
        tags=["owasp", "auth", "credentials"],
        pattern=r"""(?i)(password|secret|key)\s*=\s*["'][a-zA-Z0-9_\-]{8,}["']""",
        name="Password in a Java string",
        description="A password or key is written into a Java string.",
        remediation="Fetch it at start-up from the platform's key store, and rotate the exposed one.",
    ),
    # Cross-language pack, web APIs
    dict(
        id="owasp-api-bola-py",
        severity="HIGH",
        language="python",
        cwe="CWE-639",
        owasp="API1:2023-Broken Object Level Authorization",
        category="security",
        tags=["owasp-api", "bola"],
        pattern=r"""objects\.get\(id\s*=\s*request\.(args|GET|POST|json)\.get\(["']id["']\)\)""",
        name="Object fetched by a request id",
        description="An object is fetched by an id from the request with no visible ownership check.",
        remediation="Add the session's user to the lookup, so that foreign records are simply not found.",
    ),
    dict(
        id="owasp-api-mass-assignment-js",
        severity="HIGH",
        language="javascript",
        cwe="CWE-915",
        owasp="API3:2023-Broken Object Property Level Authorization",
        category="security",
        tags=["owasp-api", "mass-assignment"],
        pattern=r"(User|Model)\.create\(\s*req\.body\s*\)",
        name="Request body stored as is",
        description="A whole request body becomes a database record.",
        remediation="Declare which properties clients may write; everything else is set by the server.",
    ),
    dict(
        id="owasp-api-data-exposure-py",
        severity="MEDIUM",
        language="python",
        cwe="CWE-200",
        owasp="API3:2019-Excessive Data Exposure",
        category="security",
        tags=["owasp-api", "data-exposure"],
        pattern=r"return\s*jsonify\(\s*user\.__dict__\s*\)",
        name="Whole object returned",
        description="All attributes of an object go to the client.",
        remediation="Describe each response by a schema and serialise through it.",
    ),
    dict(
        id="owasp-api-no-rate-limit-py",
        severity="LOW",
        language="python",
        cwe="CWE-799",
        owasp="API4:2023-Unrestricted Resource Consumption",
        category="security",
        tags=["owasp-api", "rate-limiting"],
        pattern=r"""@app\.route\(["'].*login.*["']\)\n(?!.*limiter).*\ndef""",
        name="Login without a rate limit",
        description="A login route carries no rate limiter.",
        remediation="Count attempts per account and per address, and slow down after a few.",
    ),
]

# Rule id, severity and id seed of the quality detectors.  The
# message placeholders are filled with the matched text and the measured amount.
QUALITY_RULES: list[dict] = [
    dict(
        id=f"quality_todo_{kind.lower()}",
        severity="MEDIUM" if kind in ("FIXME", "BUG") else "LOW",
        message_template=f"{kind} found: {{short}}",
        remediations=["Do what the note asks for, or move it, with its author and date, to the tracker: {match}"],
    )
    for kind in ("TODO", "FIXME", "HACK", "XXX", "BUG")
] + [
    dict(
        id="quality_long_line",
        severity="INFO",
        message_template="Line too long ({amount} characters, maximum {limit})",
        remediations=["Let the formatter wrap it; what is still too wide usually nests too deeply"],
    ),
    dict(
        id="quality_long_function",
        severity="MEDIUM",
        message_template="Function '{match}' too long ({amount} lines, maximum {limit})",
        remediations=["Name the stages of the body in a comment each; every stage with a name can become a function"],
    ),
    dict(
        id="quality_commented_code",
        severity="LOW",
        message_template="Commented-out code",
        remediations=["The repository remembers earlier versions: take the block out in a commit that says what it did"],
    ),
    dict(
        id="quality_high_complexity",
        severity="MEDIUM",
        message_template="High complexity in '{match}' (score {amount}, maximum {limit})",
        remediations=["Return early from the special cases", "Replace chains of conditions by a table"],
    ),
]

# Our own table, from the publicly documented token formats.
SECRET_RULES: list[dict] = [
    dict(id="secret_aws_access_key", severity="CRITICAL", name="AWS access key id",
         pattern=r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    dict(id="secret_aws_secret_key", severity="CRITICAL", name="AWS secret access key",
         pattern=r"""(?i)aws_?(?:secret_?)?(?:access_?)?key\s*[=:]\s*["'][A-Za-z0-9/+=]{40}["']"""),
    dict(id="secret_github_token", severity="CRITICAL", name="GitHub token",
         pattern=r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    dict(id="secret_github_fine_grained_token", severity="CRITICAL", name="GitHub fine-grained token",
         pattern=r"\bgithub_pat_[A-Za-z0-9_]{22,}"),
    dict(id="secret_stripe_live_key", severity="CRITICAL", name="Stripe live key",
         pattern=r"\b[rs]k_live_[0-9A-Za-z]{16,}"),
    dict(id="secret_stripe_test_key", severity="MEDIUM", name="Stripe test key",
         pattern=r"\b[rs]k_test_[0-9A-Za-z]{16,}"),
    dict(id="secret_slack_token", severity="HIGH", name="Slack token",
         pattern=r"\bxox[abeoprs]-[0-9A-Za-z-]{10,}"),
    dict(id="secret_slack_webhook", severity="HIGH", name="Slack webhook",
         pattern=r"https://hooks\.slack\.com/services/[A-Za-z0-9_/]{20,}"),
    dict(id="secret_discord_token", severity="HIGH", name="Discord bot token",
         pattern=r"\b[MNO][A-Za-z0-9_-]{23,27}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,38}"),
    dict(id="secret_discord_webhook", severity="HIGH", name="Discord webhook",
         pattern=r"https://discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]{20,}"),
    dict(id="secret_jwt", severity="HIGH", name="JSON web token",
         pattern=r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    dict(id="secret_private_key", severity="CRITICAL", name="Private key",
         pattern=r"-----BEGIN (?:RSA |DSA |EC |OPENSSH )?PRIVATE KEY-----"),
    dict(id="secret_connection_string", severity="CRITICAL", name="Database connection string",
         pattern=r"""\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/"']+:[^\s@/"']+@[^\s/"']+"""),
    dict(id="secret_generic_assignment", severity="HIGH", name="Credential assignment",
         pattern=r"""(?i)\b(?:api_?key|secret|token|password|passwd)\s*[=:]\s*["'][A-Za-z0-9_\-]{16,}["']"""),
]
