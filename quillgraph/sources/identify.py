"""What a data reference is, and what an archive may hold: small rules on the driver."""

from __future__ import annotations

import ipaddress
import posixpath
import re
from urllib.parse import urlparse

#: How references of each repository look.
REPOSITORIES = [
    ("zenodo", r"(?:10\.5281/zenodo\.|zenodo\.org/records?/)(\d+)"),
    ("figshare", r"(?:10\.6084/m9\.figshare\.|figshare\.com/articles/(?:\w+/)*[^/]*/?)(\d+)"),
    ("dryad", r"(10\.5061/dryad\.[\w.]+)"),
    ("osf", r"(?:osf\.io/|10\.17605/OSF\.IO/)(\w{5,})"),
]
MOST_MEMBERS, MOST_BYTES = 5000, 500 * 1024 * 1024


def classify(reference: str) -> tuple[str, str]:
    """(repository, its id), or (url, the address); ValueError for anything else."""
    for name, pattern in REPOSITORIES:
        if m := re.search(pattern, reference, re.I):
            return name, m[1]
    if urlparse(reference).scheme in ("http", "https"):
        return "url", reference
    raise ValueError(f"not a known reference: {reference}")


def safe_address(url: str, addresses: list[str]) -> bool:
    """Whether a download may go there: web schemes only, and no private, local or reserved address."""
    if urlparse(url).scheme not in ("http", "https") or not addresses:
        return False
    return all(ipaddress.ip_address(a).is_global for a in addresses)


def safe_members(members: list[tuple[str, int]]) -> list[str]:
    """Names of an archive's files (name, size) if all stay inside it and within the limits; else ValueError."""
    if len(members) > MOST_MEMBERS or sum(size for _, size in members) > MOST_BYTES:
        raise ValueError("archive too large")
    for name, _ in members:
        path = posixpath.normpath(name.replace("\\", "/"))
        if path.startswith(("/", "..")) or re.match(r"^[A-Za-z]:", path):
            raise ValueError(f"unsafe member {name}")
    return [name for name, _ in members if not name.endswith("/")]
