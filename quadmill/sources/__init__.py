"""Sources: RDF serialisations and query languages as tables of facts."""
