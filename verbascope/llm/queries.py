"""The queries of this subpackage, by name, and their SQL."""

from . import bpe, classifier, exact_dedup, html_text, katz, mixing, quality_rules, simhash, token_counts, url_filter

_MODULES = (katz, html_text, exact_dedup, mixing, url_filter, token_counts, quality_rules, bpe, simhash, classifier)


def queries() -> dict:
    found = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
