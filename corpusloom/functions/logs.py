"""Log records without personal data: the message and its arguments."""

from __future__ import annotations

import logging
import re

from .text import REDACTIONS


class Redact(logging.Filter):
    """Redacts by the rules of text redaction."""

    rules = [(re.compile(p), to.replace("$1", r"\1")) for p, to in REDACTIONS]

    def filter(self, record: logging.LogRecord) -> bool:
        text = record.getMessage()
        for pattern, to in self.rules:
            text = pattern.sub(to, text)
        record.msg, record.args = text, None
        return True
