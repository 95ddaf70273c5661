"""Mailbox messages as rows: bounces, delivery reports, requests to leave."""

from __future__ import annotations

import email
import re
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import DataFrame

from contactloom.functions.unicode import parse_mail_date

SCHEMA = "id long, sender string, recipients array<string>, sent_at timestamp, is_bounce boolean, original_to string, dsn_action string, dsn_status string, diagnostic string, wants_out boolean, out_addresses array<string>"
_BOUNCE = re.compile(r"(mailer-daemon|postmaster|mail delivery)", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_OUT = re.compile(r"(unsubscribe|отпис|remove me)", re.I)


def _field(text: str, name: str) -> str | None:
    m = re.search(rf"^{name}:\s*(?:rfc822;)?\s*(.+)$", text, re.I | re.M)
    return m[1].strip() if m else None


def parse(raw: bytes) -> tuple:
    m = email.message_from_bytes(raw)
    sender = m.get("From", "")
    parts = [(p.get_content_type(), p) for p in m.walk()]
    report = "\n".join("\n".join(str(x) for x in p.get_payload()) if isinstance(p.get_payload(), list) else str(p.get_payload()) for t, p in parts if t == "message/delivery-status")
    inner = next((p.get_payload()[0] for t, p in parts if t == "message/rfc822" and isinstance(p.get_payload(), list)), None)
    final = _field(report, "Final-Recipient") or (inner.get("To") if inner is not None else None)
    body = "\n".join((p.get_payload(decode=True) or b"").decode(p.get_content_charset() or "utf-8", "replace") for t, p in parts if t == "text/plain")
    wants = bool(_OUT.search(f"{m.get('Subject', '')}\n{body}"))
    heads = " ".join(filter(None, (m.get("List-Unsubscribe"), m.get("Reply-To"), sender)))
    out = sorted({a.lower() for a in _ADDRESS.findall(heads)}) if wants else []
    found = _ADDRESS.search(final or "")
    return (
        sender, [a.lower() for _, a in getaddresses(m.get_all("To", [])) if a], parse_mail_date(m.get("Date")), bool(_BOUNCE.search(sender)), found[0].lower() if found else None,
        _field(report, "Action"), _field(report, "Status"), _field(report, "Diagnostic-Code"), wants, out,
    )


def messages(df: DataFrame, key: str = "id", raw: str = "raw") -> DataFrame:
    """Parsed rows of raw messages."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(k, *parse(bytes(r))) for k, r in zip(b[key], b[raw], strict=True)], columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return df.select(key, raw).mapInPandas(run, SCHEMA)
