"""Deterministic responders for the responder hook (tests and dry runs).

A real deployment passes a function that calls its model service; these
stand-ins answer from the prompt text alone so runs are reproducible.
"""

from __future__ import annotations

import hashlib
import json


def guidance_stub(prompt: str) -> str:
    """Guidance answer derived from the prompt; every 17th prompt (by hash)
    raises, exercising the request-error path."""
    digest = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    if int(digest[:4], 16) % 17 == 0:
        raise ConnectionError("stub responder: simulated timeout")
    label = "unknown"
    for line in prompt.splitlines():
        if line.strip() in ("TruePositive", "FalsePositive", "BenignPositive"):
            label = line.strip()
            break
    priority = {"TruePositive": "High", "FalsePositive": "Low"}.get(label, "Medium")
    body = {
        "analyst_summary": f"Alert classified as {label}.",
        "risk_explanation": "derived from the alert fields",
        "mitre_interpretation": ["T1110"] if "T1110" in prompt else [],
        "recommended_actions": ["review alert", "check entity"] if priority != "Low" else "close alert",
        "containment_priority": priority,
    }
    text = json.dumps(body)
    return text if int(digest[4:6], 16) % 3 else f"Here is the JSON:\n{text}\nThanks."
