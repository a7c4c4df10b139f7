"""What keeps private data out: deny patterns, extension and size rules, secret patterns, encryption."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_name, extension

#: File patterns (on the base name, or behind one leading folder) and folder patterns
#: (on any component) that are never indexed.
DENY_FILES = (
    ".env .env.* .env.local .env.production .env.development *.pem *.key *.p12 *.pfx *.jks *.keystore "
    "id_rsa id_ed25519 id_dsa id_ecdsa *.pub credentials credentials.* passwords.* password.* secrets.* secret.* "
    "config/secrets.* *.secret bank* tax* medical* insurance* salary* .DS_Store"
).split()
DENY_FOLDERS = ".git .svn .hg node_modules venv .venv __pycache__ .mypy_cache .pytest_cache .ssh".split()
#: Extensions that are indexed, and extensions that are binary.
SUPPORTED = ".txt .md .go .py .js .ts .pdf .docx .html .htm".split()
BINARY = (
    ".exe .dll .so .dylib .bin .o .obj .a .lib .zip .tar .gz .bz2 .xz .7z .rar .jpg .jpeg .png .gif .bmp .ico .svg "
    ".webp .mp3 .mp4 .avi .mov .mkv .wav .flac .db .sqlite .pyc .class"
).split()
MAX_FILE, MAX_TEXT, MAX_DEPTH = 50 * 1024 * 1024, 10 * 1024 * 1024, 20

#: Our own choice of public credential formats, as (name, pattern); ASCII, without look-around.
SECRETS = (
    ("OpenAI API key", r"sk-[A-Za-z0-9]{48}"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("GitHub token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("Private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("Slack token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("Assigned token", r"(token|api_key|password|secret) ?[=:] ?[\"'][0-9A-Za-z]{16,}[\"']"),
)


def glob_regex(glob: str) -> str:
    """The regex of a glob, for use between anchors; * and ? don't cross a slash."""
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob)


def denied(path: Column, files: tuple[str, ...] | list[str] = DENY_FILES, folders: tuple[str, ...] | list[str] = DENY_FOLDERS) -> Column:
    """Whether a file's path is denied: by its base name, by the whole path behind one folder, or by a
    component.  Case matters."""
    part = "|".join(glob_regex(p) for p in folders) or "(?!)"
    whole = "|".join(glob_regex(p) for p in files)
    return base_name(path).rlike(f"^({whole})$") | path.rlike(f"^[^/]*/({whole})$") | path.rlike(f"(^|/)({part})(/|$)")


def allowed(path: Column, folder: Column) -> Column:
    """Whether a canonical path lies in a canonical folder (or is it); a child whose name begins with two
    dots is denied, as is a path that could not be resolved (null)."""
    below = F.substr(path, F.length(folder) + 2)
    return F.coalesce((path == folder) | (path.startswith(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"))) & ~below.startswith("..")), F.lit(False))


def file_event(path: Column, size: Column, depth: Column, symlink: Column, inside: Column) -> Column:
    """The first guard that stops a file, as an audit event; `ignored` for what leaves no trace, and null
    for what goes on to be compared by hash."""
    ext = extension(path)
    return (
        F.when(depth > MAX_DEPTH, "skipped_depth").when(symlink, "skipped_symlink")
        .when(ext.isin(*BINARY) | ~ext.isin(*SUPPORTED), "ignored").when(size > MAX_FILE, "skipped_too_large")
        .when(~inside, "skipped_not_allowed").when(denied(path), "skipped_denylist")
    )


def secret_names(text: Column) -> Column:
    """Names of the secret patterns that match, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS]))


def redact(text: Column) -> Column:
    """text with each match replaced by [REDACTED:name], pattern after pattern."""
    return reduce(lambda c, s: F.regexp_replace(c, s[1], f"[REDACTED:{s[0]}]"), SECRETS, text)


def derive_key(password: str, salt: bytes) -> bytes:
    """The 32-byte key of a password (scrypt, N=32768, r=8, p=1), on the driver."""
    return hashlib.scrypt(password.encode(), salt=salt, n=32768, r=8, p=1, dklen=32, maxmem=64 << 20)


def encrypt(value: Column, key: Column) -> Column:
    """AES-256-GCM: nonce, ciphertext and tag in one binary.  A key that is a literal shows in plans and event
    logs; where these leave the machine, keep it in a table that only the job reads and join that."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(value, key, F.lit("GCM"))
