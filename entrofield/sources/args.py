"""Run configurations: `name value` lines, `#` comments."""

from __future__ import annotations

from .files import filesystem


class Args(dict):
    """Missing names give an empty string."""

    def __missing__(self, key: str) -> str:
        return ""

    def integers(self, *names: str) -> tuple[int, ...]:
        return tuple(int(self[n]) for n in names)


def parse_args(text: str) -> Args:
    out = Args()
    for line in text.splitlines():
        parts = line.split(None, 1)
        if parts and not parts[0].startswith("#"):
            out[parts[0]] = parts[1].strip() if len(parts) > 1 else ""
    return out


def read_args(path: str) -> Args:
    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        return parse_args(f.read().decode())
