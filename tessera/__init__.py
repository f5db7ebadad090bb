"""tessera: DataFrame-first operators for curating labelled collections and ordered evidence streams."""
