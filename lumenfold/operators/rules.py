"""Rule tables of the scanners: what is looked for, in which language, and what a match means.

All values here are fixed: patterns, names, severities and their order must equal those that users already have, so that
the same files give the same findings.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    issue: str
    severity: str
    pattern: str


# Extension -> language of the taint rules (fixed values).
LANGUAGES = {
    ".c": "c", ".cpp": "c", ".cc": "c", ".h": "c", ".hpp": "c", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust",
}

# Calls whose repetition on one pointer is a finding of its own (fixed value); it comes before the rules of C.
FREE = r"\bfree\s*\(\s*([a-zA-Z_]\w*)\s*\)"

# Taint rules by language, in their order (fixed values).
TAINT = {
    "c": [
        Rule("C01", "integer-overflow", "HIGH", r"\b(malloc|calloc|realloc)\s*\(\s*([^)]*?\*[^)]*?)\)"),
        Rule("C03", "off-by-one", "MEDIUM", r"for\s*\([^;]*;\s*[a-zA-Z_]\w*\s*<=\s*(?:sizeof\s*\([^)]+\)|[0-9]+)\s*;"),
        Rule("C04", "integer-truncation", "MEDIUM", r"\b(unsigned\s+char|char|short)\s+[a-zA-Z_]\w*\s*=\s*[a-zA-Z_]\w*\s*\+\s*[a-zA-Z_0-9]+"),
        Rule("C05", "null-pointer", "MEDIUM", r"\b(malloc|calloc|realloc)\s*\([^)]+\)\s*;"),
        Rule("C06", "stack-buffer-overflow", "HIGH", r"\bstrncat\s*\("),
        Rule("C07", "buffer-overflow", "MEDIUM", r"\b(memcpy|memmove)\s*\([^,]+,\s*[^,]+,\s*([a-zA-Z_]\w*)\s*\)"),
        Rule("C08", "os-command-injection", "HIGH", r"\b(system|popen)\s*\("),
        Rule("C09", "path-traversal", "MEDIUM", r"""\bfopen\s*\(\s*(?!["\"])"""),
        Rule("C10", "insecure-temp-file", "MEDIUM", r"\b(tmpnam|tempnam|mktemp)\s*\("),
        Rule("C11", "weak-rng", "LOW", r"\brand\s*\(\s*\)|\bsrand\s*\("),
        Rule("C12", "negative-index", "MEDIUM", r"\bint\s+[a-zA-Z_]\w*\s*=[^;]*;\s*\n[^;]*\[[a-zA-Z_]\w*\]"),
        Rule("C13", "off-by-one", "HIGH", r"for\s*\([^;]*;\s*[a-zA-Z_]\w*\s*<=\s*(?:[a-zA-Z_]\w*->|[a-zA-Z_]\w*\.)?[a-zA-Z_]\w*(?:_count|_cnt|_size|_num|_max|_len|_regions|_handlers|_ports)\s*;"),
        Rule("C14", "off-by-one", "MEDIUM", r"for\s*\([^;]*;\s*[a-zA-Z_]\w*\s*<=\s*[A-Z_][A-Z0-9_]+\s*;"),
        Rule("C15", "integer-truncation", "HIGH", r"static_cast\s*<\s*(?:uint16_t|uint8_t|short|unsigned short)\s*>\s*\([^)]*(?:sizeof|size|len|count|num|\*)[^)]*\)"),
        Rule("C16", "heap-buffer-overflow", "MEDIUM", r"\b(?:std::)?malloc\s*\([^)]+\)[^;]*;\s*\n(?:[^\n]*\n){0,5}[^\n]*memcpy\s*\("),
        Rule("C17", "ring-buffer-overflow", "HIGH", r"\b(?:irq_(?:head|tail)|head_idx|tail_idx|buf_head|buf_tail|wr_ptr|rd_ptr)\s*\]"),
        Rule("C18", "uncapped-loop-bound", "MEDIUM", r"for\s*\([^;]*;\s*[a-zA-Z_]\w*\s*<\s*[a-zA-Z_]\w*->(?:io|mmio|port|handler|slot)[_a-z]*count\s*;"),
    ],
    "python": [
        Rule("PY01", "sql-injection", "HIGH", r"""\.execute\s*\(\s*["'].*%[sd].*["']|\.execute\s*\(\s*[^)]*\.format\(|\.execute\s*\(\s*f["']"""),
        Rule("PY02", "os-command-injection", "HIGH", r"\bos\.system\s*\(|\bsubprocess\.(call|Popen|run)\s*\([^)]*shell=True"),
        Rule("PY03", "insecure-eval", "CRITICAL", r"\beval\s*\(|\bexec\s*\("),
        Rule("PY04", "insecure-deserialization", "CRITICAL", r"\bpickle\.loads?\s*\(|\bpickle\.load\s*\(|\byaml\.load\s*\([^)]+\)(?!\s*,\s*Loader)"),
        Rule("PY05", "xxe-injection", "MEDIUM", r"\blxml\.etree|xml\.etree\.ElementTree|xml\.dom\.minidom"),
        Rule("PY06", "hardcoded-password", "HIGH", r"""(?i)(password|secret|api_key|token)\s*=\s*["'][^"']{4,}["']"""),
        Rule("PY07", "path-traversal", "HIGH", r"\bopen\s*\(\s*(?:request\.|input\(|os\.path\.join)[^)]*\)"),
        Rule("PY08", "ssrf", "HIGH", r"""\brequests\.(get|post|put|delete)\s*\(\s*(?!["'](http|https))"""),
        Rule("PY09", "weak-crypto", "MEDIUM", r"\bhashlib\.(md5|sha1)\s*\("),
        Rule("PY10", "insecure-config", "HIGH", r"\.run\s*\([^)]*debug\s*=\s*True"),
        Rule("PY11", "template-injection", "HIGH", r"""render_template_string\s*\(|Template\s*\(\s*(?!["'f])"""),
        Rule("PY12", "weak-rng", "LOW", r"\brandom\.(?:random|randint|choice|shuffle)\s*\("),
        Rule("PY13", "jwt-none-alg", "CRITICAL", r"""algorithms\s*=\s*\[\s*["']none["']"""),
        Rule("PY14", "insecure-config", "MEDIUM", r"\bapp\.add_url_rule\s*\(.*\.\*\*"),
        Rule("PY15", "xxe-injection", "HIGH", r"<!ENTITY\s+\w+\s+SYSTEM"),
    ],
    "java": [
        Rule("JV01", "sql-injection", "HIGH", r"Statement\s*\.\s*(execute|executeQuery|executeUpdate)\s*\(\s*[^)]*\+"),
        Rule("JV02", "sql-injection", "MEDIUM", r"createStatement\s*\(\s*\)"),
        Rule("JV03", "os-command-injection", "HIGH", r"Runtime\.getRuntime\(\)\.exec\s*\("),
        Rule("JV04", "insecure-deserialization", "CRITICAL", r"ObjectInputStream\s*\(|\.readObject\s*\("),
        Rule("JV05", "path-traversal", "MEDIUM", r"""new\s+File\s*\(\s*(?!["'"])"""),
        Rule("JV06", "xxe-injection", "HIGH", r"DocumentBuilderFactory\.newInstance\(\)|SAXParserFactory\.newInstance\(\)"),
        Rule("JV07", "weak-crypto", "HIGH", r"""getInstance\s*\(\s*["'](?:MD5|SHA1|DES|RC4)["']"""),
        Rule("JV08", "hardcoded-password", "HIGH", r"""(?i)(password|secret|apikey|token)\s*=\s*["'][^"']{4,}["']"""),
        Rule("JV09", "ldap-injection", "HIGH", r"new\s+InitialDirContext|DirContext\s*\.\s*search\s*\("),
        Rule("JV10", "template-injection", "HIGH", r"ExpressionParser|StandardEvaluationContext"),
        Rule("JV11", "open-redirect", "MEDIUM", r"response\.sendRedirect\s*\(\s*request\.getParameter"),
        Rule("JV12", "weak-rng", "LOW", r"\bnew\s+Random\s*\("),
        Rule("JV13", "input-validation", "LOW", r"request\.getParameter\s*\([^)]+\)\s*(?:;|\n)"),
    ],
    "go": [
        Rule("GO01", "sql-injection", "HIGH", r"\.Query\s*\(\s*(?:fmt\.Sprintf|[a-zA-Z_]\w*\s*\+)"),
        Rule("GO02", "os-command-injection", "HIGH", r"exec\.Command\s*\([^)]*\+"),
        Rule("GO03", "path-traversal", "MEDIUM", r"os\.Open\s*\(|ioutil\.ReadFile\s*\(|http\.ServeFile\s*\("),
        Rule("GO04", "insecure-tls", "HIGH", r"InsecureSkipVerify\s*:\s*true"),
        Rule("GO05", "weak-crypto", "MEDIUM", r"md5\.New\(\)|sha1\.New\(\)"),
        Rule("GO06", "hardcoded-password", "HIGH", r"""(?i)(password|secret|apiKey|token)\s*:?=\s*"[^"]{4,}\""""),
        Rule("GO07", "race-condition", "MEDIUM", r"go\s+func\s*\("),
        Rule("GO08", "open-redirect", "MEDIUM", r"http\.Redirect\s*\([^,]+,\s*[^,]+,\s*r\.(?:FormValue|URL\.Query)"),
        Rule("GO09", "ssrf", "HIGH", r"""http\.(?:Get|Post)\s*\(\s*(?!["'])"""),
        Rule("GO10", "resource-leak", "LOW", r"make\s*\(\s*chan\s+"),
        Rule("GO11", "integer-overflow", "MEDIUM", r"int\s*\([^)]*\)\s*\*\s*int\s*\("),
    ],
    "rust": [
        Rule("RS01", "unsafe-block", "HIGH", r"\bunsafe\s*\{"),
        Rule("RS02", "unsafe-block", "HIGH", r"\*\s*(?:mut|const)\s+[a-zA-Z_]\w*|\bas\s+\*(?:mut|const)"),
        Rule("RS03", "panic-unwrap", "LOW", r"\.unwrap\(\)|\.expect\("),
        Rule("RS04", "unsafe-block", "CRITICAL", r"\bstd::mem::transmute\b|\bmem::transmute\b"),
        Rule("RS05", "weak-crypto", "MEDIUM", r"extern\s+crate\s+(?:md5|sha1)\b"),
        Rule("RS06", "hardcoded-password", "HIGH", r"""(?i)(password|secret|api_key|token)\s*:\s*&str\s*=\s*"[^"]{4,}\""""),
        Rule("RS07", "os-command-injection", "HIGH", r"Command::new\s*\(\s*format!"),
    ],
}

# Infrastructure rules by framework, in their order (fixed values). ^ and $ match at lines; docker ignores case.
INFRASTRUCTURE = {
    "terraform": [
        Rule("TF001", "iac-public-s3-bucket", "CRITICAL", r'(?m)acl\s*=\s*"public-read"'),
        Rule("TF002", "iac-public-s3-bucket", "CRITICAL", r'(?m)acl\s*=\s*"public-read-write"'),
        Rule("TF003", "iac-open-security-group", "HIGH", r'(?m)ingress\s*\{[^}]*cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"\s*\]'),
        Rule("TF004", "iac-overly-permissive-ports", "HIGH", r"(?m)(?:from_port|to_port)\s*=\s*0.*(?:from_port|to_port)\s*=\s*65535"),
        Rule("TF005", "iac-unencrypted-storage", "HIGH", r"(?m)encrypted\s*=\s*false"),
        Rule("TF006", "iac-no-versioning", "MEDIUM", r"(?m)versioning\s*\{[^}]*enabled\s*=\s*false"),
        Rule("TF007", "iac-no-logging", "MEDIUM", r"(?m)logging\s*\{?\s*\}|access_logs\s*\{?\s*enabled\s*=\s*false"),
        Rule("TF008", "iac-hardcoded-secret", "HIGH", r'(?m)(?:password|secret|api_key|token)\s*=\s*"[^"]{4,}"'),
        Rule("TF009", "iac-public-database", "HIGH", r"(?m)publicly_accessible\s*=\s*true"),
        Rule("TF010", "iac-all-protocols", "MEDIUM", r'(?m)protocol\s*=\s*"-1"'),
        Rule("TF011", "iac-no-deletion-protection", "HIGH", r"(?m)deletion_protection\s*=\s*false"),
        Rule("TF012", "iac-single-az", "MEDIUM", r"(?m)multi_az\s*=\s*false"),
        Rule("TF013", "iac-weak-tls", "HIGH", r'(?m)ssl_policy\s*=\s*"(?:ELBSecurityPolicy-2016-08|ELBSecurityPolicy-TLS-1-0)"'),
        Rule("TF014", "iac-no-key-rotation", "MEDIUM", r"(?m)enable_key_rotation\s*=\s*false"),
    ],
    "kubernetes": [
        Rule("K8S001", "iac-privileged-container", "CRITICAL", r"(?m)privileged\s*:\s*true"),
        Rule("K8S002", "iac-run-as-root", "HIGH", r"(?m)runAsUser\s*:\s*0\b"),
        Rule("K8S003", "iac-privilege-escalation", "HIGH", r"(?m)allowPrivilegeEscalation\s*:\s*true"),
        Rule("K8S004", "iac-writable-rootfs", "MEDIUM", r"(?m)readOnlyRootFilesystem\s*:\s*false"),
        Rule("K8S005", "iac-host-network", "HIGH", r"(?m)hostNetwork\s*:\s*true"),
        Rule("K8S006", "iac-host-pid", "HIGH", r"(?m)hostPID\s*:\s*true"),
        Rule("K8S007", "iac-latest-tag", "MEDIUM", r"(?m)(?:image|Image)\s*:\s*\S+(?::latest\b|[^:])\s*$"),
        Rule("K8S008", "iac-excessive-capabilities", "MEDIUM", r"(?m)capabilities\s*:\s*\n\s*add\s*:\s*\n\s*-\s*(?:ALL|SYS_ADMIN|NET_ADMIN)"),
        Rule("K8S009", "iac-exposed-service", "HIGH", r"(?m)type\s*:\s*(?:NodePort|LoadBalancer)"),
        Rule("K8S010", "iac-no-resource-limits", "MEDIUM", r"(?m)(?:limits|requests)\s*:(?!\s*\n\s+(?:cpu|memory))"),
        Rule("K8S011", "iac-automount-sa-token", "HIGH", r"(?m)automountServiceAccountToken\s*:\s*true"),
    ],
    "docker": [
        Rule("DF001", "iac-docker-latest-base", "HIGH", r"(?mi)^FROM\s+\S+:latest\b"),
        Rule("DF002", "iac-docker-root-user", "CRITICAL", r"(?mi)^USER\s+root\s*$"),
        Rule("DF003", "iac-docker-secret-env", "HIGH", r"(?mi)(?:ENV|ARG)\s+(?:PASSWORD|SECRET|API_KEY|TOKEN|AWS_SECRET)\s*=\s*\S+"),
        Rule("DF004", "iac-docker-add-url", "MEDIUM", r"(?mi)^ADD\s+https?://"),
        Rule("DF005", "iac-docker-no-recommends", "LOW", r"(?mi)apt-get\s+install(?!.*--no-install-recommends)"),
        Rule("DF006", "iac-docker-admin-port", "MEDIUM", r"(?mi)EXPOSE\s+(?:22|23|3389|5900)\b"),
        Rule("DF007", "iac-docker-copy-all", "MEDIUM", r"(?mi)COPY\s+\.\s+\."),
        Rule("DF008", "iac-docker-chmod-777", "MEDIUM", r"(?mi)chmod\s+777\b"),
        Rule("DF009", "iac-docker-security-disabled", "HIGH", r"(?mi)--security-opt\s+(?:no-new-privileges\s*=\s*false|apparmor\s*=\s*unconfined|seccomp\s*=\s*unconfined)"),
    ],
    "cloudformation": [
        Rule("CFN001", "iac-cfn-public-s3", "CRITICAL", r'(?m)(?:PublicAccessBlockConfiguration|BlockPublicAcls)\s*:\s*(?:false|"false")'),
        Rule("CFN002", "iac-cfn-open-sg", "HIGH", r'(?m)CidrIp\s*:\s*(?:")?0\.0\.0\.0/0'),
        Rule("CFN003", "iac-cfn-no-encryption", "HIGH", r'(?m)(?:SSEAlgorithm|ServerSideEncryptionConfiguration)\s*:\s*(?:false|"false"|"none")'),
        Rule("CFN004", "iac-cfn-public-rds", "HIGH", r'(?m)PubliclyAccessible\s*:\s*(?:true|"true")'),
        Rule("CFN005", "iac-cfn-no-retain", "MEDIUM", r'(?m)DeletionPolicy\s*:\s*(?:Delete|"Delete")'),
        Rule("CFN006", "iac-cfn-single-az", "MEDIUM", r'(?m)MultiAZ\s*:\s*(?:false|"false")'),
    ],
    "ansible": [
        Rule("ANS001", "iac-ansible-hardcoded-secret", "HIGH", r"""(?m)(?:password|secret|token)\s*:\s*(?!"\{\{)["'][^"']{4,}"""),
        Rule("ANS002", "iac-ansible-become-root", "MEDIUM", r"(?m)become\s*:\s*(?:yes|true)(?!.*become_user)"),
        Rule("ANS003", "iac-ansible-pipe-to-shell", "HIGH", r"(?m)(?:shell|command)\s*:.*(?:curl|wget)\s+.*\|\s*(?:sh|bash)"),
        Rule("ANS004", "iac-ansible-chmod-777", "MEDIUM", r"""(?m)mode\s*:\s*["']?0?777"""),
    ],
}

# Rules on the stripped lines of container files: id, category, severity, weakness, pattern; case is ignored (fixed values).
CONTAINER = [
    ("CONT-PRIV-001", "privilege", "high", "CWE-250", r"^\s*USER\s+root\s*$"),
    ("CONT-PRIV-002", "privilege", "critical", "CWE-250", r"--privileged"),
    ("CONT-PRIV-003", "privilege", "medium", "CWE-732", r"chmod\s+[0-7]*[2367][0-7]*\s"),
    ("CONT-SC-001", "supply-chain", "high", "CWE-829", r"^\s*ADD\s+https?://"),
    ("CONT-SC-002", "supply-chain", "critical", "CWE-829", r"curl\s.*\|\s*(?:bash|sh|python)"),
    ("CONT-SC-003", "supply-chain", "critical", "CWE-829", r"wget\s.*\|\s*(?:bash|sh)"),
    ("CONT-SC-004", "supply-chain", "medium", "CWE-250", r"npm\s+install\s.*--unsafe-perm"),
    ("CONT-NET-001", "network", "high", "CWE-284", r"^\s*EXPOSE\s+22\b"),
    ("CONT-NET-002", "network", "medium", "CWE-284", r"^\s*EXPOSE\s+(?:3306|5432|27017|6379|11211)\b"),
    ("CONT-SEC-001", "filesystem", "critical", "CWE-312", r"(?:COPY|ADD)\s+.*(?:\.env|\.pem|\.key|id_rsa|credentials|\.aws)\b"),
    ("CONT-SEC-002", "filesystem", "high", "CWE-798", r"ENV\s+\w*(?:PASSWORD|SECRET|TOKEN|API_KEY|PRIVATE_KEY)\w*\s*="),
    ("CONT-BP-002", "base-image", "low", "", r"apt-get\s+(?:install|update)(?!.*--no-install-recommends)"),
    ("CONT-BP-003", "base-image", "low", "", r"apt-get\s+(?:update|install)(?!.*&&\s*(?:rm|apt-get clean))"),
    ("CONT-BP-004", "base-image", "low", "", r"^\s*HEALTHCHECK\s+NONE"),
]

# The same for compose files (fixed values).
COMPOSE = [
    ("CONT-COMP-001", "privilege", "critical", "CWE-250", r"privileged:\s*true"),
    ("CONT-COMP-002", "network", "high", "CWE-284", r"""network_mode:\s*["']?host"""),
    ("CONT-COMP-003", "privilege", "high", "CWE-250", r"""pid:\s*["']?host"""),
    ("CONT-COMP-004", "privilege", "medium", "CWE-250", r"""ipc:\s*["']?host"""),
    ("CONT-COMP-005", "privilege", "high", "CWE-250", r"cap_add:\s*\n\s*-\s*(?:ALL|SYS_ADMIN|NET_ADMIN)"),
    ("CONT-COMP-006", "filesystem", "high", "CWE-668", r"volumes:.*:/(?:etc|var|root|proc|sys)\b"),
]

# Base images past their end of life, with severities (fixed values).
ENDED = {
    "ubuntu:14.04": "critical", "ubuntu:16.04": "high", "ubuntu:18.04": "medium", "debian:stretch": "high",
    "debian:jessie": "critical", "debian:buster": "medium", "centos:6": "critical", "centos:7": "high",
    "centos:8": "high", "alpine:3.13": "medium", "alpine:3.14": "medium", "alpine:3.15": "low", "node:8": "critical",
    "node:10": "high", "node:12": "high", "node:14": "medium", "python:2.7": "critical", "python:3.6": "high",
    "python:3.7": "medium", "golang:1.16": "medium", "golang:1.17": "medium", "ruby:2.5": "high", "ruby:2.6": "medium",
    "php:7.3": "high", "php:7.4": "medium",
}

# Names of official base images (fixed values).
OFFICIAL = [
    "alpine", "ubuntu", "debian", "centos", "fedora", "amazonlinux", "node", "python", "golang", "ruby", "php", "openjdk",
    "eclipse-temurin", "rust", "nginx", "httpd", "redis", "postgres", "mysql", "mongo", "busybox", "scratch",
    "buildpack-deps",
]
