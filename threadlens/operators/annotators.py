"""Example Python annotators for EN10 (``list[str] -> list[str]``), importable on workers."""

from __future__ import annotations


def scripted_python_annotator(prompts: list[str]) -> list[str]:
    """Answers each batch prompt with one JSON element per numbered comment line."""
    out = []
    for p in prompts:
        n = sum(1 for line in p.split("\n\n") if line[:1].isdigit() and ". [Score: " in line)
        els = [f'{{"comment_id": "{i + 1}", "quality_score": {(len(p) + i) % 11}, "intent_primary": "ASK"}}'
               for i in range(n)]
        out.append("[" + ", ".join(els) + "]")
    return out
