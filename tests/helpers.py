"""Row builders and plain-Python oracles for the tests."""
from __future__ import annotations

from datetime import datetime

from vacantia.schema import POSTING

NOW = datetime(2026, 5, 29, 12, 0, 0)


def posting(job_id, *, title="Engineer", company="Acme", location="Remote", salary=None, salary_max=None,
            salary_min=None, description="", url=None, source="greenhouse", posted_date=NOW, is_remote=True,
            job_type=None, job_level=None, flags=None, llm_score=None, ord=0):
    return {
        "job_id": job_id, "title": title, "company": company, "location": location, "salary": salary,
        "description": description, "description_snippet": description[:60],
        "url": url or f"https://example.com/jobs/{job_id}", "source": source, "posted_date": posted_date,
        "is_remote": is_remote, "job_type": job_type, "job_level": job_level, "salary_min_amount": salary_min,
        "salary_max_amount": salary_max, "flags": flags or [], "skills": [], "relevance": 0.0,
        "llm_score": llm_score, "llm_verdict": None, "llm_reason": None,
        "ord": (0, 0, ord),
    }


def frame(spark, rows):
    rows = [dict(r, ord=(0, 0, i)) for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f] for f in POSTING.fieldNames()) for r in rows], POSTING)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    return 100.0 if not total else (1 - (total - 2 * lcs(a, b)) / total) * 100


def fold(rows):
    """Sequential merge of copies given in arrival order."""
    kept = None
    for row in rows:
        row = dict(row)
        if kept is None:
            kept = row
            continue
        old_wins = (len(kept["description"]), len(kept["title"])) >= (len(row["description"]), len(row["title"]))
        top, rest = (kept, row) if old_wins else (row, kept)
        if top["salary"] is None and rest["salary"] is not None:
            for f in ("salary", "salary_min_amount", "salary_max_amount"):
                top[f] = rest[f]
        for f in ("posted_date", "is_remote"):
            if top[f] is None:
                top[f] = rest[f]
        top["job_type"] = top["job_type"] or rest["job_type"] or top["job_type"]
        kept = top
    return kept


def greedy(rows, threshold):
    """Sequential fuzzy merge: list of (first position, members)."""
    text = lambda r: f"{r['company']} {r['title']} {r['location']}".lower().strip()
    kept = []
    for row in rows:
        for slot in kept:
            if ratio(text(slot["top"]), text(row)) >= threshold:
                slot["rows"].append(row)
                slot["top"] = fold(slot["rows"])
                break
        else:
            kept.append({"rows": [row], "top": row})
    return kept
