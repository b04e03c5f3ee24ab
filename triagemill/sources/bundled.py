"""Bundled data sets as small literal tables, so that no executor needs a file of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import Rule

# --- Fixed values: techniques (id, name, tactics, text), in corpus order -------------------------------------
TECHNIQUES = (
    (
        "T1059",
        "Command and Scripting Interpreter",
        "Execution",
        "Adversaries may abuse command and script interpreters such as PowerShell, cmd.exe, bash, or Python to "
        "execute commands, scripts, or binaries during post-exploitation. PowerShell is frequently used for "
        "living-off-the-land execution because it is trusted, pre-installed, and highly capable.",
    ),
    (
        "T1053",
        "Scheduled Task/Job",
        "Execution, Persistence, Privilege Escalation",
        "Adversaries may abuse task scheduling functionality (schtasks, cron, at) to execute malicious code at a "
        "specific time or on a recurring interval, often used to establish persistence after initial access.",
    ),
    (
        "T1055",
        "Process Injection",
        "Defense Evasion, Privilege Escalation",
        "Adversaries may inject code into the address space of another process to evade process-based defenses and "
        "elevate privileges. Common techniques include DLL injection, process hollowing, and reflective loading.",
    ),
    (
        "T1027",
        "Obfuscated Files or Information",
        "Defense Evasion",
        "Adversaries may encode, encrypt, pack, or otherwise obfuscate malicious payloads, scripts, or command-line "
        "arguments (e.g. base64-encoded PowerShell) to make static detection and analysis harder.",
    ),
    (
        "T1003",
        "OS Credential Dumping",
        "Credential Access",
        "Adversaries may dump credentials from the operating system and software, such as LSASS memory or the SAM "
        "database, using tools like Mimikatz, secretsdump, or built-in utilities, to obtain account hashes and "
        "passwords.",
    ),
    (
        "T1078",
        "Valid Accounts",
        "Defense Evasion, Persistence, Privilege Escalation, Initial Access",
        "Adversaries may use compromised or stolen credentials for legitimate accounts to bypass access controls and "
        "blend in with normal user activity, evading detection that targets malware or exploit-based intrusions.",
    ),
    (
        "T1071",
        "Application Layer Protocol",
        "Command and Control",
        "Adversaries may communicate using application-layer protocols such as HTTP, HTTPS, or DNS to blend "
        "command-and-control traffic with legitimate network traffic and evade network-based detection.",
    ),
    (
        "T1090",
        "Proxy",
        "Command and Control",
        "Adversaries may use a connection proxy, such as Tor exit nodes, VPS relays, or compromised infrastructure, "
        "to direct command-and-control traffic and obscure the true source or destination of the communication.",
    ),
    (
        "T1105",
        "Ingress Tool Transfer",
        "Command and Control",
        "Adversaries may transfer tools or other files from an external system into a compromised environment, often "
        "via HTTP downloads, to stage additional malware or post-exploitation tooling.",
    ),
    (
        "T1041",
        "Exfiltration Over C2 Channel",
        "Exfiltration",
        "Adversaries may steal data by exfiltrating it over an existing command-and-control channel rather than a "
        "separate exfiltration channel, blending stolen data transfer with normal beaconing traffic.",
    ),
    (
        "T1486",
        "Data Encrypted for Impact",
        "Impact",
        "Adversaries, most commonly associated with ransomware, may encrypt data on target systems to interrupt "
        "availability and extort payment for restoring access, often after credential theft and lateral movement.",
    ),
    (
        "T1566",
        "Phishing",
        "Initial Access",
        "Adversaries may send phishing messages with malicious attachments or links to gain access to victim "
        "systems, frequently used as the initial access vector before deploying malware or harvesting credentials.",
    ),
    (
        "T1204",
        "User Execution",
        "Execution",
        "Adversaries may rely on a user opening a malicious file, clicking a link, or enabling macros to execute "
        "their payload, often as the follow-through step after a phishing email is delivered.",
    ),
    (
        "T1046",
        "Network Service Discovery",
        "Discovery",
        "Adversaries may attempt to get a listing of services running on remote hosts, including those that may be "
        "vulnerable to remote exploitation, using tools such as nmap or masscan during reconnaissance.",
    ),
    (
        "T1021",
        "Remote Services",
        "Lateral Movement",
        "Adversaries may use valid accounts to log into remote services such as RDP, SSH, or SMB/WinRM to move "
        "laterally within a network once initial access has been established.",
    ),
)

# --- Fixed values: demonstration feed (value, category, confidence, source, notes) ---------------------------
FEED = (
    ("185.220.101.1", "ipv4", "high", "demo-feed",
     "Known Tor exit node observed proxying C2 traffic in prior incidents."),
    ("45.155.205.7", "ipv4", "high", "demo-feed", "Associated with commodity malware C2 infrastructure."),
    ("evil-c2-panel.com", "domain", "high", "demo-feed",
     "Registered domain matching a known C2 panel naming pattern."),
    ("update-service-cdn.net", "domain", "medium", "demo-feed",
     "Lookalike domain impersonating legitimate update infrastructure."),
    ("44d88612fea8a8f36de82e1278abb02f", "md5", "high", "demo-feed",
     "MD5 of the EICAR test file family used in this demo dataset."),
    ("5f4dcc3b5aa765d61d8327deb882cf99", "md5", "medium", "demo-feed",
     "Sample hash flagged in a prior credential-dumping investigation."),
)

# --- Fixed values: detection rules, in rule order ------------------------------------------------------------
_ALL = ("name", "exe", "cmdline")
DEFAULT_RULES = (
    Rule("credential-dumping-mimikatz", r"mimikatz", _ALL, "critical", "Credential Access", "T1003",
         "Mimikatz is a widely used credential dumping tool."),
    Rule("credential-dumping-secretsdump", r"secretsdump|hashdump|dumpsec", _ALL, "critical", "Credential Access",
         "T1003", "Impacket secretsdump / hashdump-style credential extraction."),
    Rule("c2-framework-cobaltstrike", r"cobaltstrike|beacon\.exe", _ALL, "critical", "Command and Control", "T1071",
         "Cobalt Strike beacon or teamserver artifact."),
    Rule("exploitation-framework-metasploit", r"metasploit|meterpreter", _ALL, "critical", "Execution", "T1203",
         "Metasploit / Meterpreter exploitation framework."),
    Rule("lateral-movement-psexec", r"psexec", _ALL, "high", "Lateral Movement", "T1021.002",
         "PsExec-style remote service execution."),
    Rule("lateral-movement-evilwinrm", r"evil-?winrm", _ALL, "high", "Lateral Movement", "T1021.006",
         "Evil-WinRM remote shell over WinRM."),
    Rule("ad-recon-bloodhound", r"bloodhound|sharphound", _ALL, "high", "Discovery", "T1087.002",
         "Active Directory attack-path enumeration tooling."),
    Rule("ad-attack-impacket", r"impacket", _ALL, "high", "Lateral Movement", "T1021",
         "Impacket tooling used for AD attacks and lateral movement."),
    Rule("kerberos-attack", r"kerberoast|rubeus|asreproast", _ALL, "high", "Credential Access", "T1558",
         "Kerberoasting / AS-REP roasting tooling."),
    Rule("c2-proxy-tooling", r"proxychains|proxycap|fakenet", _ALL, "medium", "Command and Control", "T1090",
         "Traffic proxying/tunneling tools sometimes abused for C2 relay."),
    Rule("network-recon", r"^nmap$|^masscan$|responder", _ALL, "medium", "Discovery", "T1046",
         "Active network/service scanning or LLMNR/NBT-NS poisoning tool."),
    Rule("web-attack-tooling", r"sqlmap|gobuster|dirbuster|burpsuite", _ALL, "medium", "Reconnaissance", "T1595",
         "Web application attack/enumeration tooling."),
    Rule("packet-capture", r"wireshark|tcpdump|ettercap", _ALL, "low", "Collection", "T1040",
         "Network sniffing / packet capture tooling."),
    Rule("password-cracking", r"johntheripper|john-the-ripper|\bhydra\b|aircrack-ng", _ALL, "high",
         "Credential Access", "T1110", "Offline/online password cracking tooling."),
    Rule("lolbin-living-off-the-land", r"wmic\.exe|regsvr32\.exe|certutil\.exe|bitsadmin\.exe", ("name", "exe"),
         "medium", "Defense Evasion", "T1218",
         "Living-off-the-land binary frequently abused for execution/evasion."),
    Rule("suspicious-powershell-encoded", r"powershell(\.exe)?.*(-enc|-encodedcommand|-nop|-w\s+hidden)",
         ("cmdline",), "high", "Execution", "T1059.001",
         "PowerShell invoked with obfuscation/encoded-command or hidden-window flags."),
    Rule("scheduled-task-persistence", r"schtasks(\.exe)?.*\/create", ("cmdline",), "medium", "Persistence",
         "T1053.005", "Scheduled task creation, a common persistence mechanism."),
    Rule("reverse-shell-netcat", r"\bnc(\.exe)?\b.*-e\s|\bncat\b.*-e\s|\bnetcat\b", _ALL, "high",
         "Command and Control", "T1059", "Netcat/ncat invoked in a pattern consistent with a reverse/bind shell."),
)

# --- Fixed values: keywords, in list order -------------------------------------------------------------------
KEYWORDS = tuple(
    """
    mimikatz cobaltstrike metasploit powershell nc.exe netcat ncat ps1 cmd.exe wmic.exe psexec bloodhound impacket
    sharpdump sharpwmi evilwinrm responder kerberoast rubeus secretsdump hashdump dumpsec crackmapexec powershell_ise
    sqlmap wireshark tcpdump aircrack-ng ettercap johntheripper hydra gobuster dirbuster fiddler burpsuite nmap masscan
    nessus snort sniff proxychains proxycap fakenet regsvr32 certutil bitsadmin schtasks tasklist taskkill taskmgr
    regedit
    """.split()
)


def literal_table(spark: SparkSession, rows: Sequence[Sequence[object]], names: Sequence[str]) -> DataFrame:
    """A table from constants of the plan; its size is known to the optimizer."""
    items = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def techniques(spark: SparkSession) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(TECHNIQUES)]
    return literal_table(spark, rows, ("ord", "id", "name", "tactic", "text"))


def demo_feed(spark: SparkSession) -> DataFrame:
    rows = [(i, *e) for i, e in enumerate(FEED)]
    return literal_table(spark, rows, ("pos", "value", "category", "confidence", "source", "notes"))
