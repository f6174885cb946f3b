"""SPARQL over DataFrames: graphs of RDF terms, or ordinary tables read as such."""
