"""Resolution of references against a base URL (RFC 3986)."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
#: Characters that stay as they are in a path or query; all others are percent-encoded as UTF-8.
_SAFE = "!$&'()*+,/:;=@-._~%"


@lru_cache(maxsize=4096)
def _base(url: str) -> str | None:
    try:
        return url if urlsplit(url).scheme else None
    except ValueError:
        return None


def resolve(reference: str, base: str) -> str | None:
    """The absolute URL of ``reference`` on a page at ``base``, its path percent-encoded; None if it cannot be read."""
    reference = reference.strip()
    try:
        full = urljoin(base, reference) if not _SCHEME.match(reference) else reference
        parts = urlsplit(full)
        if not parts.scheme:
            return None
        if parts.scheme in ("http", "https"):
            return urlunsplit((parts.scheme, parts.netloc, quote(parts.path, safe=_SAFE), parts.query, quote(parts.fragment, safe=_SAFE + "?"))) + ("#" if full.endswith("#") and not parts.fragment else "")
        return full
    except ValueError:
        return None


def netloc(url: str) -> str:
    try:
        return urlsplit(url).netloc.rpartition("@")[2].lower()
    except ValueError:
        return ""
