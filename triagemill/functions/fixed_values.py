"""Fixed values.

Everything here is data whose exact value decides whether a result is right: word lists, thresholds, weights,
address ranges, patterns and the wording of generated text. Nothing in this module computes anything.
"""

# --- Fixed values: kinds of authentication event -------------------------------------------------------------
KIND_FAILED = "ssh_failed_password"
KIND_ACCEPTED = "ssh_accepted"
KIND_SUDO = "sudo_command"
KIND_USERADD = "useradd"
KIND_CRONTAB = "crontab_replace"
KIND_OTHER = "other"

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

# --- Fixed values: detector defaults -------------------------------------------------------------------------
BRUTE_FORCE_WINDOW_SECONDS = 60
BRUTE_FORCE_THRESHOLD = 5
COMPROMISE_LOOKBACK_SECONDS = 120
COMPROMISE_MIN_FAILURES = 3
ESCALATION_CORRELATION_SECONDS = 600

# --- Fixed values: severities, their order and their weight in the risk score --------------------------------
AUTH_SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
AUTH_SEVERITY_WEIGHT = {"LOW": 5, "MEDIUM": 15, "HIGH": 30, "CRITICAL": 50}
RISK_SCORE_CAP = 100
RULE_SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}

# --- Fixed values: wording of authentication findings (format strings) ---------------------------------------
BRUTE_FORCE_TITLE = "Possible SSH brute force from %s"
BRUTE_FORCE_TEXT = "%d failed password attempts from %s within %ds, targeting user(s): %s."
COMPROMISE_TITLE = "Successful login for '%s' after brute force"
COMPROMISE_TEXT = (
    "%s succeeded logging in as '%s' after %d failed attempts in the preceding %ds. Credentials may be compromised."
)
ESCALATION_TITLE = "Root privilege escalation by '%s'"
ESCALATION_TEXT = "'%s' ran '%s' as root via sudo."
ESCALATION_SUFFIX = " This occurred shortly after a suspected credential compromise."
ROOT_ACCOUNT_TITLE = "Root-equivalent account created: %s"
ROOT_ACCOUNT_TEXT = (
    "User '%s' was created with UID=0 (root-equivalent), a common backdoor persistence technique."
)
CRONTAB_TITLE = "Crontab replaced for user '%s'"
CRONTAB_TEXT = "The crontab for '%s' was replaced, which can be used to establish scheduled-task persistence."

# --- Fixed values: wording of the incident narrative ---------------------------------------------------------
NARRATIVE_EMPTY = (
    "No security-relevant patterns were detected in the analyzed log. No further action is recommended."
)
NARRATIVE_OPENING = "%d finding(s) detected, highest severity %s, risk score %d/100."
NARRATIVE_BRUTE_FORCE = "Evidence indicates a brute-force credential attack, "
NARRATIVE_SUCCEEDED = "which appears to have succeeded."
NARRATIVE_NOT_CONFIRMED = "with no confirmed successful login."
NARRATIVE_ESCALATION = "%d root privilege escalation event(s) observed via sudo."
NARRATIVE_PERSISTENCE = (
    "Possible persistence mechanisms detected (root-equivalent account creation and/or crontab modification)."
)
NARRATIVE_ADVICE = (
    "Recommended actions: rotate credentials for affected accounts, review and remove unauthorized accounts/cron "
    "entries, and inspect the source IP(s) named in the evidence against threat intelligence feeds."
)

# --- Fixed values: defanged spellings, replaced in this order ------------------------------------------------
DEFANGED = (
    ("hxxps://", "https://"),
    ("hxxp://", "http://"),
    ("[.]", "."),
    ("(.)", "."),
    ("[:]", ":"),
    ("[at]", "@"),
    ("[@]", "@"),
)

# --- Fixed values: indicator patterns ------------------------------------------------------------------------
URL_PATTERN = r"""\bhttps?://[^\s"'<>)]+"""
EMAIL_LOCAL = r"[a-zA-Z0-9._%+-]"
EMAIL_HOST = r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
HEX_PATTERN = r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b"
CVE_PATTERN = r"\bCVE-\d{4}-\d{4,7}\b"
IPV4_PATTERN = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
DOMAIN_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
DOMAIN_ENDING = r"[a-zA-Z]{2,24}\b"
HEX_CATEGORY = {64: "sha256", 40: "sha1", 32: "md5"}
CATEGORIES = ("cve", "domain", "email", "ipv4", "md5", "sha1", "sha256", "url")
CONTEXT_RADIUS = 40

DOMAIN_STOP_LIST = ("e.g.com", "i.e.com")
TOP_LEVEL_DOMAINS = tuple(
    """
    com net org io gov edu mil info biz co us uk ca de fr ru cn jp au nl br in it es se no fi dk pl ch at be nz ie za
    mx kr sg hk tw xyz top club online site app dev me tv cc ai eu asia name pro mobi tech cloud email live world
    group company network systems solutions services vip icu work link click download stream su int coop travel
    museum aero jobs rocks guru ninja pw shop store blog news wiki
    """.split()
)

# --- Fixed values: addresses that are not globally routable, and the two exceptions --------------------------
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "255.255.255.255/32",
)
PUBLIC_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
NOTE_PRIVATE = "RFC 1918 private address — internal asset, not internet-routable."
NOTE_NO_MATCH = "No match in local threat-intel feed."

# --- Fixed values: tokens and weights of technique retrieval -------------------------------------------------
TOKEN_PATTERN = r"[a-zA-Z][a-zA-Z0-9_.-]{1,}"
STOP_WORDS = (
    "the", "and", "or", "to", "of", "in", "on", "for", "with", "as", "by", "is", "are", "may", "an", "a", "that",
    "this", "such", "into", "be", "their", "at", "from",
)
HIGH_IMPACT_TACTICS = ("Impact", "Exfiltration", "Credential Access")
HIGH_IMPACT_RELEVANCE = 0.15
STRONG_RELEVANCE = 0.3
TOP_K = 3

# --- Fixed values: wording of the alert summary and of the prompt table --------------------------------------
SUMMARY_NOTICE = "[offline heuristic summary]"
SUMMARY_SEVERITY = "Severity: %s."
SUMMARY_FLAGGED = "Known-malicious indicators observed: %s."
SUMMARY_NONE_FLAGGED = "No indicators matched the local threat-intel feed."
SUMMARY_TECHNIQUE = "Alert language most closely resembles ATT&CK technique %s (%s, tactic: %s)."
SUMMARY_NEXT_STEPS = (
    "Recommended next steps: isolate affected host(s) if severity is high or critical, pivot on the flagged "
    "indicators in EDR/SIEM for related activity, and confirm whether the matched ATT&CK technique aligns with the "
    "raw log evidence before closing or escalating the alert."
)
PROMPT_ALERT = "## Alert"
PROMPT_INDICATORS = "## Extracted indicators"
PROMPT_NO_INDICATORS = "- (none found)"
PROMPT_ENRICHMENT = "## Threat-intel enrichment"
PROMPT_HIT = "- %s (%s) — KNOWN MALICIOUS, confidence=%s, source=%s: %s"
PROMPT_NO_HITS = "- No indicators matched the local threat-intel feed."
PROMPT_TECHNIQUES = "## Retrieved ATT&CK context (RAG)"
PROMPT_TECHNIQUE = "- %s %s (%s) [relevance=%s]: %s"
PROMPT_NO_TECHNIQUES = "- No closely matching techniques retrieved."
PROMPT_SEVERITY = "## Heuristic severity: "

# --- Fixed values: rule table columns ------------------------------------------------------------------------
RULE_REQUIRED_KEYS = ("id", "match_fields", "mitre_tactic", "mitre_technique", "pattern", "severity")
RULE_MATCH_FIELDS = ("cmdline", "exe", "name")
