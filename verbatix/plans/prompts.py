"""Prompt texts for a client: what is asked for, numbered steps, and the rules that hold for all. No data is read."""

from __future__ import annotations

# The rules of every workflow, and the steps of each.
RULES = (
    "Ne rien affirmer qui ne figure pas dans les passages renvoyés par les tools.",
    "Citer entre guillemets le champ `quote`, mot pour mot, et joindre le champ `citation`.",
    "Distinguer explicitement ce qui est une citation, ce qui est un résumé et ce qui est une inférence.",
    "Quand le niveau de preuve est `not_found`, écrire que le corpus ne documente pas cette position — ne jamais la déduire.",
    "Rappeler que les positions citées sont celles de la campagne présidentielle de 2022, pas nécessairement la ligne actuelle du parti.",
)
COMPARE_STEPS = (
    "Appelle `compare_parties` avec ce thème.",
    "Pour chaque parti, restitue la position telle qu'elle ressort des passages, en citant au moins un extrait mot pour mot.",
    "Signale les partis dont le niveau de preuve est `not_found` ou `weak_inference`, sans combler le vide.",
    "Termine par les points de convergence et de divergence qui ressortent des citations elles-mêmes.",
)
SUMMARY_STEPS = (
    "Appelle `search_documents` en filtrant sur ce parti et ce thème.",
    "Si un passage semble ambigu ou tronqué, appelle `get_passage` pour lire son contexte avant de conclure.",
    "Structure la réponse en mesures concrètes, chacune adossée à une citation.",
    "Indique ce que le programme ne dit pas, si la question porte sur un point non couvert.",
)
QUOTE_STEPS = (
    "Appelle `search_documents` avec les termes saillants de l'affirmation.",
    "Appelle `get_passage` sur les passages les plus proches, pour vérifier qu'ils ne sont pas sortis de leur contexte.",
    "Conclus par l'un de ces verdicts, et un seul : **confirmée par une citation directe**, **partiellement confirmée** (en précisant l'écart exact avec le texte), **non documentée par le corpus**, ou **contredite par le texte**.",
    "Un verdict n'est recevable qu'accompagné du passage exact sur lequel il repose. L'absence de résultat n'est jamais une réfutation : c'est une absence de source.",
)


def _prompt(asked: str, steps: tuple[str, ...]) -> str:
    numbered = "\n".join(f"{n}. {step}" for n, step in enumerate(steps, 1))
    rules = "\n".join(f"- {rule}" for rule in RULES)
    return f"{asked}\n\nMarche à suivre :\n{numbered}\n\nRègles :\n{rules}"


def compare_topic(topic: str) -> str:
    return _prompt(f"Compare les positions des partis français sur le thème « {topic} », d'après les programmes de l'élection présidentielle de 2022.", COMPARE_STEPS)


def summarize_group_position(group: str, topic: str) -> str:
    return _prompt(f"Résume la position de « {group} » sur « {topic} » d'après son programme de la présidentielle 2022.", SUMMARY_STEPS)


def find_direct_quote(claim: str, group: str | None = None) -> str:
    laid_to = f"\nElle est prêtée à : {group}." if group else ""
    return _prompt(f"Vérifie l'affirmation suivante contre les programmes de la présidentielle 2022 :\n« {claim} »{laid_to}", QUOTE_STEPS)
