"""The rules shipped by default.

Fixed values: names, texts, patterns, thresholds, severities, confidences and
attack ids.
"""

from palisade.rules.model import Condition, Rule, numbered

PRIVATE_SOURCE = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)"


def _is(field, value):
    return Condition(field, "equals", value=value)


def _like(field, pattern):
    return Condition(field, "regex", pattern=pattern)


DEFAULT_RULES = numbered(
    [
        Rule(
            "Port Scan Detection",
            "Detects port scanning activity - connections to multiple ports from single source",
            "threshold",
            "Detect >10 unique destination ports from single IP in 60 seconds",
            "high",
            "network",
            threshold=10,
            time_window_seconds=60,
            confidence=0.85,
            category="reconnaissance",
            tags=("scanning", "reconnaissance", "nmap"),
            attack_tactics=("TA0043",),
            attack_techniques=("T1046",),
        ),
        Rule(
            "SSH Brute Force",
            "Multiple failed SSH login attempts from same source",
            "threshold",
            "Detect >5 connections to port 22 from single IP in 120 seconds",
            "high",
            "network",
            (_is("dst_port", 22),),
            threshold=5,
            time_window_seconds=120,
            confidence=0.80,
            category="credential_access",
            tags=("brute_force", "ssh", "credential_access"),
            attack_tactics=("TA0006",),
            attack_techniques=("T1110.001",),
        ),
        Rule(
            "RDP Brute Force",
            "Multiple RDP connection attempts",
            "threshold",
            "Detect >5 connections to port 3389 from single IP in 120 seconds",
            "high",
            "network",
            (_is("dst_port", 3389),),
            threshold=5,
            time_window_seconds=120,
            confidence=0.80,
            category="credential_access",
            tags=("brute_force", "rdp", "credential_access"),
            attack_tactics=("TA0006",),
            attack_techniques=("T1110.001",),
        ),
        Rule(
            "Large Data Upload",
            "Unusually large data transfer from internal host",
            "pattern",
            "Detect outbound traffic >10MB from internal IP",
            "medium",
            "network",
            (
                Condition("bytes_sent", "range", min=10485760),
                _like("src_ip", PRIVATE_SOURCE),
            ),
            confidence=0.60,
            category="exfiltration",
            tags=("exfiltration", "data_theft"),
            attack_tactics=("TA0010",),
            attack_techniques=("T1041",),
        ),
        Rule(
            "SMB Lateral Movement",
            "Internal SMB connections (potential lateral movement)",
            "pattern",
            "Detect internal-to-internal SMB traffic",
            "medium",
            "network",
            (
                Condition("dst_port", "in", values=(445, 139)),
                _like("src_ip", PRIVATE_SOURCE),
                _like("dst_ip", PRIVATE_SOURCE),
            ),
            confidence=0.50,
            category="lateral_movement",
            tags=("lateral_movement", "smb"),
            attack_tactics=("TA0008",),
            attack_techniques=("T1021.002",),
        ),
        Rule(
            "DNS Tunneling Candidate",
            "High volume of DNS queries (potential DNS tunneling)",
            "threshold",
            "Detect >50 DNS queries from single host in 60 seconds",
            "medium",
            "network",
            (_is("dst_port", 53),),
            threshold=50,
            time_window_seconds=60,
            confidence=0.65,
            category="command_and_control",
            tags=("c2", "dns_tunneling", "exfiltration"),
            attack_tactics=("TA0011",),
            attack_techniques=("T1071.004",),
        ),
        Rule(
            "Telnet Usage",
            "Unencrypted telnet protocol detected",
            "pattern",
            "Detect any telnet connection",
            "low",
            "network",
            (_is("dst_port", 23),),
            confidence=0.70,
            category="policy_violation",
            tags=("insecure_protocol", "telnet", "policy"),
        ),
        Rule(
            "ICMP Flood",
            "High volume of ICMP traffic",
            "threshold",
            "Detect >100 ICMP packets from single source in 10 seconds",
            "medium",
            "network",
            (_is("protocol", "ICMP"),),
            threshold=100,
            time_window_seconds=10,
            confidence=0.75,
            category="denial_of_service",
            tags=("dos", "icmp", "flood"),
            attack_tactics=("TA0040",),
            attack_techniques=("T1498",),
        ),
        Rule(
            "PowerShell Encoded Command",
            "PowerShell with encoded/obfuscated command",
            "pattern",
            "Detect powershell -enc or -encodedcommand",
            "critical",
            "host",
            (
                _like("process_name", "powershell"),
                _like("command_line", "-enc(odedcommand)?"),
            ),
            confidence=0.90,
            category="execution",
            tags=("powershell", "obfuscation", "execution"),
            attack_tactics=("TA0002",),
            attack_techniques=("T1059.001",),
        ),
        Rule(
            "Suspicious Download via Command Line",
            "wget/curl/Invoke-WebRequest downloading files",
            "pattern",
            "Detect wget, curl, or PowerShell download commands",
            "high",
            "host",
            (_like("command_line", "(wget|curl|Invoke-WebRequest|iwr|WebClient).*http"),),
            confidence=0.75,
            category="command_and_control",
            tags=("download", "c2", "staging"),
            attack_tactics=("TA0011",),
            attack_techniques=("T1105",),
        ),
        Rule(
            "Netcat Usage",
            "Netcat reverse shell or listener",
            "pattern",
            "Detect netcat (nc) process execution",
            "critical",
            "host",
            (_like("process_name", "(nc|ncat|netcat)"),),
            confidence=0.85,
            category="command_and_control",
            tags=("reverse_shell", "c2", "netcat"),
            attack_tactics=("TA0011",),
            attack_techniques=("T1071",),
        ),
        Rule(
            "Privilege Escalation - Sudo",
            "Multiple sudo command executions",
            "threshold",
            "Detect >5 sudo commands from single user in 60 seconds",
            "medium",
            "host",
            (Condition("command_line", "contains", value="sudo"),),
            threshold=5,
            time_window_seconds=60,
            grouping_key="username",
            confidence=0.65,
            category="privilege_escalation",
            tags=("privilege_escalation", "sudo"),
            attack_tactics=("TA0004",),
            attack_techniques=("T1548.003",),
        ),
        Rule(
            "Mimikatz Credential Dumping",
            "Mimikatz process detected",
            "pattern",
            "Detect mimikatz process",
            "critical",
            "host",
            (_like("process_name", "mimikatz"),),
            confidence=0.95,
            category="credential_access",
            tags=("mimikatz", "credential_dumping"),
            attack_tactics=("TA0006",),
            attack_techniques=("T1003.001",),
        ),
        Rule(
            "Base64 in Command Line",
            "Base64 encoding in command (potential obfuscation)",
            "pattern",
            "Detect base64 or FromBase64String in commands",
            "medium",
            "host",
            (_like("command_line", "(base64|FromBase64String)"),),
            confidence=0.60,
            category="defense_evasion",
            tags=("obfuscation", "base64", "evasion"),
            attack_tactics=("TA0005",),
            attack_techniques=("T1027",),
        ),
        Rule(
            "Scheduled Task Creation",
            "schtasks or at command for persistence",
            "pattern",
            "Detect scheduled task creation commands",
            "medium",
            "host",
            (_like("command_line", "(schtasks|at )/create"),),
            confidence=0.70,
            category="persistence",
            tags=("persistence", "scheduled_task"),
            attack_tactics=("TA0003",),
            attack_techniques=("T1053.005",),
        ),
        Rule(
            "Registry Autorun Modification",
            "Modification of registry autorun keys",
            "pattern",
            "Detect reg add to Run/RunOnce keys",
            "high",
            "host",
            (_like("command_line", "reg add.*(Run|RunOnce)"),),
            confidence=0.80,
            category="persistence",
            tags=("persistence", "registry", "autorun"),
            attack_tactics=("TA0003",),
            attack_techniques=("T1547.001",),
        ),
        Rule(
            "Shadow Copy Deletion",
            "vssadmin delete shadows (ransomware indicator)",
            "pattern",
            "Detect shadow copy deletion commands",
            "critical",
            "host",
            (_like("command_line", "vssadmin.*delete.*shadows"),),
            confidence=0.90,
            category="impact",
            tags=("ransomware", "shadow_copy", "deletion"),
            attack_tactics=("TA0040",),
            attack_techniques=("T1490",),
        ),
    ]
)
