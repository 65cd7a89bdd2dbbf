"""All registered queries of the reference operators and their SQL."""

from speechtab.plans import hyps, manifests, texts

ALL = {**manifests.Q, **texts.Q, **hyps.Q}


def queries() -> dict:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}
