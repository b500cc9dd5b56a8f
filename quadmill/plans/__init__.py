"""Front-ends: SPARQL, Datalog and ShEx text to DataFrame plans."""
