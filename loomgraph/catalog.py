"""What the graph holds: classes with their tables, properties, other names."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Namespace of the graph's own terms, unless a catalog names another.
NAMESPACE = "https://example.org/campus#"

#: Public namespaces whose terms are other names of classes, and common prefixes.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "schema": "https://schema.org/",
    "dbo": "http://dbpedia.org/ontology/",
    "wd": "http://www.wikidata.org/entity/",
    "teach": "http://linkedscience.org/teach/ns#",
    "aiiso": "http://purl.org/vocab/aiiso/schema#",
    "vivo": "http://vivoweb.org/ontology/core#",
    "bibo": "http://purl.org/ontology/bibo/",
    "bowlogna": "http://www.bowlogna.org/ontology#",
}
#: The classes' other names.
ALIASES = {
    "Module": ("teach:Course", "aiiso:Course", "vivo:Course", "bowlogna:Module", "schema:Course", "wd:Q600134"),
    "Book": ("teach:Material", "dbo:Book", "bibo:Book", "schema:Book", "wd:Q571"),
    "Course": ("schema:EducationalOccupationalProgram", "teach:StudyProgram"),
    "Department": ("schema:School",),
    "University": ("schema:CollegeOrUniversity",),
}
SUPER = {"LearningEntity": ("Module", "Book", "Course"), "AcademicEntity": ("Department", "University")}


@dataclass(frozen=True)
class Property:
    """A property: of which classes, to a class (``to``) or to a kind of literal."""

    name: str
    of: tuple[str, ...]
    to: str | None = None
    kind: str = "str"


CLASSES = ("University", "Department", "Course", "Module", "Book")
PROPERTIES = (
    Property("hasDepartment", ("University",), "Department"),
    Property("hasCourse", ("Department",), "Course"),
    Property("hasModule", ("Course",), "Module"),
    Property("hasBook", ("Module",), "Book"),
    Property("title", ("Module", "Book", "Course")),
    Property("name", ("Department", "University")),
    Property("semester", ("Module",)),
    Property("year", ("Course",), kind="int"),
    Property("hasCode", ("Module", "Book", "Department")),
    Property("hasURL", ("Book", "Course")),
)


@dataclass(frozen=True)
class Catalog:
    """Names of the graph. A user of another namespace passes theirs and keeps all queries as they are."""

    namespace: str = NAMESPACE
    prefixes: dict[str, str] = field(default_factory=lambda: dict(PREFIXES))
    #: A collation under which ``=``, ``!=``, ``IN``, ``CONTAINS``, ``STRSTARTS`` and ``STRENDS`` compare text in
    #: filters, for instance ``UNICODE_CI_AI``, to which case and accents are the same; none: character by character.
    collation: str | None = None

    def iri(self, name: str) -> str:
        prefix, _, local = name.rpartition(":")
        return (self.prefixes[prefix] if prefix else self.namespace) + local

    def key_prefix(self, cls: str) -> str:
        """What stands before the key in the IRI of an instance."""
        return f"{self.namespace}{cls.lower()}_"

    def classes_of(self, iri: str) -> tuple[str, ...] | None:
        """Classes whose instances have a type, by its own name, an alias or a superclass."""
        for cls in CLASSES:
            if iri == self.iri(cls) or iri in map(self.iri, ALIASES.get(cls, ())):
                return (cls,)
        return next((members for name, members in SUPER.items() if iri == self.iri(name)), None)

    def types_of(self, cls: str) -> list[str]:
        """All types that an instance of a class has."""
        return [self.iri(cls), *map(self.iri, ALIASES.get(cls, ())), *(self.iri(s) for s, m in SUPER.items() if cls in m)]

    def property(self, iri: str) -> Property | None:
        return next((p for p in PROPERTIES if self.iri(p.name) == iri), None)

    def unknown_terms(self, query_iris: list[str]) -> list[str]:
        """Terms in the graph's namespace that name no class, property or instance: worth a warning."""
        keys = tuple(map(self.key_prefix, CLASSES))
        return [i for i in query_iris if i.startswith(self.namespace) and not self.classes_of(i) and not self.property(i) and not i.startswith(keys)]
