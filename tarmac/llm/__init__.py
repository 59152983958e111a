"""Training-data operators for large text, vector and URL corpora.

One module per operator; each takes DataFrames and returns DataFrames. The
rest of the library never imports this subpackage. ``queries`` holds the
registered query functions and their SQL twins.
"""
