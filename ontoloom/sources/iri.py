"""Namespaces and the predicates that labels and hierarchies are read from."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SKOSXL = "http://www.w3.org/2008/05/skos-xl#"
XML = "http://www.w3.org/XML/1998/namespace"

LABEL, SUBCLASS, TYPE = RDFS + "label", RDFS + "subClassOf", RDF + "type"
#: The form that some ontologies mint, and the widely published one.
SYNONYMS = ("http://purl.obolibrary.org/obo/hasExactSynonym", "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym")
PREF_LABEL, ALT_LABEL, LITERAL_FORM = SKOSXL + "prefLabel", SKOSXL + "altLabel", SKOSXL + "literalForm"
BROADER, NARROWER, RELATED, EXACT_MATCH = SKOS + "broader", SKOS + "narrower", SKOS + "related", SKOS + "exactMatch"
