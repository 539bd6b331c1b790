"""Fixed values that must equal the reference behaviour for identical results.

Everything here is data (lists, maps, text templates), stated as plain text in
its natural order. Logic lives in ``functions/`` and ``operators/``.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: label domain and error sentinels
# ---------------------------------------------------------------------------
LABELS = ["BenignPositive", "FalsePositive", "TruePositive"]
TARGET_COL = "IncidentGrade"
PARSE_ERROR = "PARSE_ERROR"
REQUEST_ERROR = "REQUEST_ERROR"
INVALID_LABEL = "INVALID_LABEL"

# ---------------------------------------------------------------------------
# FIXED VALUES: the 13 alert feature columns, in text order
# ---------------------------------------------------------------------------
FEATURE_COLUMNS = [
    "Category",
    "MitreTechniques",
    "EntityType",
    "EvidenceRole",
    "DetectorId",
    "AlertTitle",
    "SuspicionLevel",
    "LastVerdict",
    "CountryCode",
    "State",
    "City",
    "OSFamily",
    "OSVersion",
]
ID_COLUMNS = ["Id", "IncidentId", "AlertId", "Timestamp"]
FIELD_SEPARATOR = " | "
NULL_VALUE_TEXT = "unknown"

# ---------------------------------------------------------------------------
# FIXED VALUES: keyword lists of the rule baseline (substring presence)
# ---------------------------------------------------------------------------
TRUE_POSITIVE_KEYWORDS = [
    "credentialaccess",
    "commandandcontrol",
    "exfiltration",
    "lateralmovement",
    "execution",
    "persistence",
    "privilegeescalation",
    "defenseevasion",
    "t1110",
    "t1078",
    "t1021",
    "t1047",
    "t1105",
    "t1569",
    "suspicionlevel: suspicious",
    "lastverdict: malicious",
]
BENIGN_KEYWORDS = [
    "benign",
    "lastverdict: clean",
    "lastverdict: benign",
    "suspicionlevel: unknown",
    "category: discovery",
    "category: initialaccess",
]
FALSE_POSITIVE_KEYWORDS = [
    "falsepositive",
    "lastverdict: unknown",
    "mitretechniques: unknown",
    "entitytype: url",
    "evidencerole: related",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: label alias maps (keys are lower-cased, '_' -> ' ')
# ---------------------------------------------------------------------------
LABEL_ALIASES_WIDE = {
    "true positive": "TruePositive",
    "truepositive": "TruePositive",
    "malicious": "TruePositive",
    "real threat": "TruePositive",
    "false positive": "FalsePositive",
    "falsepositive": "FalsePositive",
    "benign positive": "BenignPositive",
    "benignpositive": "BenignPositive",
    "benign": "BenignPositive",
}
LABEL_ALIASES_NARROW = {
    "truepositive": "TruePositive",
    "true positive": "TruePositive",
    "falsepositive": "FalsePositive",
    "false positive": "FalsePositive",
    "benignpositive": "BenignPositive",
    "benign positive": "BenignPositive",
    "benign": "BenignPositive",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: answer defaults per answer profile
# ---------------------------------------------------------------------------
TRIAGE_PARSE_FALLBACK_SUMMARY = "Could not parse model output as JSON."
TRIAGE_REQUEST_FAILED_PREFIX = "Ollama request failed: "
HYBRID_PARSE_FALLBACK_SUMMARY = "Could not parse JSON output."
SERVICE_PARSE_FALLBACK_SUMMARY = "Could not parse LLM output as JSON."
HYBRID_DEFAULT_PRIORITY = "Unknown"

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt templates. ``{alert_text}`` / ``{ml_prediction}`` are
# the only placeholders; the rendered prompt has outer whitespace stripped.
# ---------------------------------------------------------------------------
ZERO_SHOT_TEMPLATE = """
You are a cybersecurity SOC alert triage analyst.

Your task is to classify the following security alert into exactly one of these labels:

1. TruePositive
Meaning: the alert likely represents real malicious or suspicious security activity.

2. FalsePositive
Meaning: the alert was likely triggered incorrectly and does not represent a real security issue.

3. BenignPositive
Meaning: the alert is technically valid, but the activity is likely benign, expected, or low-risk.

Return ONLY valid JSON.
Do not include markdown.
Do not include explanation outside the JSON.

Required JSON schema:
{
  "predicted_label": "TruePositive or FalsePositive or BenignPositive",
  "confidence": 0.0,
  "reasoning_summary": "brief analyst explanation",
  "recommended_actions": [
    "action 1",
    "action 2",
    "action 3"
  ]
}

Security alert:
{alert_text}
"""

FEW_SHOT_HEADER = """
You are a cybersecurity SOC alert triage analyst.

Classify the security alert into exactly one label:
- TruePositive
- FalsePositive
- BenignPositive

Important:
The alert fields are anonymized and encoded.
Use patterns from the examples below.

Examples:

"""

FEW_SHOT_FOOTER = """Now classify the new alert.

Return ONLY valid JSON.
Do not include markdown.
Do not include explanation outside JSON.

Required JSON schema:
{
  "predicted_label": "TruePositive or FalsePositive or BenignPositive",
  "confidence": 0.0,
  "reasoning_summary": "brief analyst explanation",
  "recommended_actions": [
    "action 1",
    "action 2",
    "action 3"
  ]
}

New security alert:
{alert_text}
"""

# The four labelled examples of the few-shot prompt (alert text, label).
FEW_SHOT_EXAMPLES = [
    ("Category: CredentialAccess | MitreTechniques: T1110;T1078 | EntityType: User | EvidenceRole: Impacted | DetectorId: 468 | AlertTitle: 24 | SuspicionLevel: unknown | LastVerdict: unknown | CountryCode: 242 | State: 1445 | City: 10630 | OSFamily: 5 | OSVersion: 66", "BenignPositive"),
    ("Category: Exfiltration | MitreTechniques: unknown | EntityType: User | EvidenceRole: Impacted | DetectorId: 58 | AlertTitle: 43 | SuspicionLevel: unknown | LastVerdict: unknown | CountryCode: 242 | State: 1445 | City: 10630 | OSFamily: 5 | OSVersion: 66", "FalsePositive"),
    ("Category: InitialAccess | MitreTechniques: unknown | EntityType: Ip | EvidenceRole: Related | DetectorId: 7 | AlertTitle: 6 | SuspicionLevel: unknown | LastVerdict: unknown | CountryCode: 31 | State: 6 | City: 3 | OSFamily: 5 | OSVersion: 66", "TruePositive"),
    ("Category: CommandAndControl | MitreTechniques: unknown | EntityType: Url | EvidenceRole: Related | DetectorId: 2 | AlertTitle: 2 | SuspicionLevel: Suspicious | LastVerdict: Suspicious | CountryCode: 242 | State: 1445 | City: 10630 | OSFamily: 5 | OSVersion: 66", "BenignPositive"),
]
FEW_SHOT_EXAMPLE_FORMAT = "Alert:\n{alert_text}\nLabel:\n{label}\n\n"

# Batch hybrid job template.
HYBRID_TEMPLATE = """
You are a cybersecurity SOC analyst.

A machine learning classifier has already predicted this alert as:

{ml_prediction}

Your job is NOT to change the label.
Your job is to generate an analyst-facing explanation and response guidance.

Return ONLY valid JSON.
Do not include markdown.
Do not include text outside the JSON.

Required JSON schema:
{
  "analyst_summary": "brief plain-English summary of the alert",
  "risk_explanation": "why this alert may matter in a SOC context",
  "mitre_interpretation": [
    "possible MITRE ATT&CK tactic or technique based on the alert fields"
  ],
  "recommended_actions": [
    "specific action 1",
    "specific action 2",
    "specific action 3",
    "specific action 4"
  ],
  "containment_priority": "Low or Medium or High"
}

Alert:
{alert_text}
"""

# Online service template (one word differs: "outside JSON").
HYBRID_TEMPLATE_SERVICE = """
You are a cybersecurity SOC analyst.

A machine learning classifier has already predicted this alert as:

{ml_prediction}

Your job is NOT to change the label.
Your job is to generate an analyst-facing explanation and response guidance.

Return ONLY valid JSON.
Do not include markdown.
Do not include text outside JSON.

Required JSON schema:
{
  "analyst_summary": "brief plain-English summary of the alert",
  "risk_explanation": "why this alert may matter in a SOC context",
  "mitre_interpretation": [
    "possible MITRE ATT&CK tactic or technique based on the alert fields"
  ],
  "recommended_actions": [
    "specific action 1",
    "specific action 2",
    "specific action 3",
    "specific action 4"
  ],
  "containment_priority": "Low or Medium or High"
}

Alert:
{alert_text}
"""

SFT_SYSTEM_PROMPT = """You are a cybersecurity SOC alert triage analyst.
Classify the alert into exactly one label:
TruePositive, FalsePositive, or BenignPositive.
Return only valid JSON with this schema:
{"predicted_label":"TruePositive or FalsePositive or BenignPositive"}"""
SFT_INPUT_PREFIX = "Security alert:\n"
SFT_INPUT_SUFFIX = "\n\nReturn only JSON."
SFT_OUTPUT_PREFIX = '{"predicted_label": "'
SFT_OUTPUT_SUFFIX = '"}'

# ---------------------------------------------------------------------------
# FIXED VALUES: sampling parameters of the reference jobs
# ---------------------------------------------------------------------------
RANDOM_STATE = 42
TEST_FRACTION = 0.2
EVAL_SUBSET_SIZE = 300
SFT_MAX_TRAIN_ROWS = 12000
SFT_VAL_SIZE = 1000

# Text model parameters (vectoriser + classifier defaults the reference uses).
TFIDF_MAX_FEATURES = 20000
TFIDF_MIN_DF = 2
LR_MAX_ITER = 1000
LR_C = 1.0

# Model-comparison rows: (model, role).
MODEL_ROLES = {
    "Rule-Based Baseline": "Traditional heuristic SOC logic",
    "TF-IDF + Logistic Regression": "Classical ML classifier",
    "Qwen Zero-Shot": "Direct LLM classification",
    "Qwen Few-Shot": "Prompt-engineered LLM classification",
    "LoRA-SFT": "Task-specific fine-tuned LLM classifier",
    "Hybrid ML + Qwen": "ML prediction with LLM explanation and playbook generation",
}

# CSV tokens pandas reads as missing by default.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
