"""Groups, topics and their labels. All of it is a parameter of the operators; the values below are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.text import normalize_label


@dataclass(frozen=True)
class Group:
    """A group of documents that searches balance and comparisons report on."""

    id: str
    name: str
    short_name: str
    representative: str = ""
    bloc: str = ""
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Topic:
    id: str
    label: str
    description: str = ""
    keywords: tuple[str, ...] = ()


# The five groups of the default corpus, in output order.
GROUPS = (
    Group("lfi", "La France insoumise", "LFI", "Jean-Luc Mélenchon", "Gauche radicale (Union populaire)", ("lfi", "france insoumise", "insoumis", "melenchon", "mélenchon", "union populaire")),
    Group("rn", "Rassemblement national", "RN", "Marine Le Pen", "Extrême droite", ("rn", "rassemblement national", "le pen", "lepen", "front national")),
    Group("renaissance", "Renaissance (ex-La République en marche)", "Renaissance", "Emmanuel Macron", "Centre (Ensemble)", ("renaissance", "lrem", "la republique en marche", "ensemble", "macron", "majorite presidentielle")),
    Group("ps", "Parti socialiste", "PS", "Anne Hidalgo", "Gauche sociale-démocrate", ("ps", "parti socialiste", "socialiste", "hidalgo")),
    Group("lr", "Les Républicains", "LR", "Valérie Pécresse", "Droite", ("lr", "les republicains", "républicains", "pecresse", "pécresse", "droite republicaine")),
)

# The ten topics of the default corpus and their keywords.
TOPICS = (
    Topic("retraites", "Retraites", "Âge de départ, durée de cotisation, pensions, régimes spéciaux, pénibilité.", ("retraite", "retraites", "pension", "pensions", "cotisation", "cotisations", "annuités", "trimestres", "âge de départ", "régimes spéciaux", "pénibilité", "capitalisation", "répartition", "minimum vieillesse")),
    Topic("immigration", "Immigration et asile", "Entrées et séjours, droit d'asile, naturalisation, regroupement familial, frontières.", ("immigration", "immigré", "immigrés", "migrant", "migrants", "asile", "réfugié", "réfugiés", "étranger", "étrangers", "naturalisation", "nationalité", "regroupement familial", "titre de séjour", "sans-papiers", "expulsion", "frontières", "schengen", "aide médicale d'état", "droit du sol")),
    Topic("securite", "Sécurité et justice", "Police, gendarmerie, délinquance, peines, prisons, terrorisme.", ("sécurité", "police", "policier", "policiers", "gendarmerie", "délinquance", "criminalité", "justice", "peine", "peines", "prison", "prisons", "magistrat", "magistrats", "terrorisme", "violences", "récidive", "impunité", "tribunal")),
    Topic("ecologie", "Écologie et énergie", "Climat, transition énergétique, nucléaire, renouvelables, biodiversité, pollution.", ("écologie", "écologique", "climat", "climatique", "carbone", "transition énergétique", "énergie", "nucléaire", "renouvelable", "renouvelables", "éolien", "éoliennes", "solaire", "biodiversité", "pollution", "environnement", "gaz à effet de serre", "rénovation thermique", "planification écologique")),
    Topic("sante", "Santé", "Hôpital, sécurité sociale, accès aux soins, déserts médicaux, dépendance.", ("santé", "hôpital", "hôpitaux", "soignant", "soignants", "médecin", "médecins", "infirmier", "infirmiers", "sécurité sociale", "assurance maladie", "remboursement", "désert médical", "déserts médicaux", "ehpad", "dépendance", "grand âge", "soins")),
    Topic("education", "Éducation et recherche", "École, enseignants, université, formation, recherche publique.", ("école", "écoles", "éducation", "enseignant", "enseignants", "professeur", "professeurs", "élève", "élèves", "collège", "lycée", "université", "étudiant", "étudiants", "recherche", "formation", "apprentissage", "scolaire", "baccalauréat")),
    Topic("institutions", "Institutions et démocratie", "Constitution, République, référendum, proportionnelle, décentralisation, laïcité.", ("constitution", "constitutionnel", "république", "référendum", "ric", "proportionnelle", "assemblée nationale", "sénat", "démocratie", "élection", "élections", "vote", "décentralisation", "collectivités", "laïcité", "sixième république", "institutions", "séparation des pouvoirs")),
    Topic("travail", "Travail et emploi", "Salaires, smic, chômage, temps de travail, droit du travail, syndicats.", ("travail", "emploi", "salaire", "salaires", "smic", "chômage", "chômeurs", "temps de travail", "35 heures", "code du travail", "syndicat", "syndicats", "précarité", "cdi", "cdd", "pouvoir d'achat", "revalorisation", "entreprise")),
    Topic("fiscalite", "Fiscalité et budget", "Impôts, TVA, ISF, dette publique, dépenses de l'État, fraude fiscale.", ("impôt", "impôts", "fiscalité", "fiscal", "tva", "isf", "csg", "taxe", "taxes", "dette", "déficit", "budget", "dépenses publiques", "fraude fiscale", "évasion fiscale", "héritage", "succession", "cotisations patronales", "niches fiscales")),
    Topic("europe", "Europe et international", "Union européenne, traités, souveraineté, otan, défense, diplomatie.", ("europe", "européen", "européenne", "union européenne", "bruxelles", "traité", "traités", "euro", "souveraineté", "otan", "défense", "armée", "diplomatie", "international", "commission européenne", "frontex")),
)

SOURCE_TYPES = ("official_program", "thematic_booklet", "campaign_leaflet", "official_webpage")


def resolve_group(label: str, groups: tuple[Group, ...] = GROUPS) -> str | None:
    """The group id that a free label names: an id first, then aliases in list order; None if unknown."""
    wanted = normalize_label(label)
    by_id = [g.id for g in groups if g.id == wanted]
    return (by_id + [g.id for g in groups if wanted in map(normalize_label, g.aliases)] + [None])[0]


def resolve_topic(label: str, topics: tuple[Topic, ...] = TOPICS) -> str | None:
    """The topic id that a free label names, by id or by label; None if unknown."""
    wanted = normalize_label(label)
    by_id = [t.id for t in topics if t.id == wanted]
    return (by_id + [t.id for t in topics if normalize_label(t.label) == wanted] + [None])[0]


def require_group(label: str, groups: tuple[Group, ...] = GROUPS) -> str:
    found = resolve_group(label, groups)
    if found is None:
        raise ValueError(f"unknown group {label!r}; expected one of {', '.join(g.id for g in groups)}")
    return found


def require_topic(label: str, topics: tuple[Topic, ...] = TOPICS) -> Topic:
    found = resolve_topic(label, topics)
    if found is None:
        raise ValueError(f"unknown topic {label!r}; expected one of {', '.join(t.id for t in topics)}")
    return next(t for t in topics if t.id == found)


def require_groups(labels: list[str] | None, groups: tuple[Group, ...] = GROUPS) -> list[str]:
    """Ids for a list of labels, duplicates kept, in the order given; all groups for None or an empty list."""
    if not labels:
        return [g.id for g in groups]
    unknown = [x for x in labels if resolve_group(x, groups) is None]
    if unknown:
        raise ValueError(f"unknown groups {', '.join(unknown)}; expected {', '.join(g.id for g in groups)}")
    return [resolve_group(x, groups) for x in labels]


def require_int(name: str, value: int, least: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{name} must be a whole number from {least} to {most}")
    return value


def require_query(query: str) -> str:
    if not isinstance(query, str) or len(query) < 2:
        raise ValueError("a query needs two characters at least")
    return query
