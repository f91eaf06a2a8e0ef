"""Training-data operators: formatting, mixing, de-duplication, tokenisation, scoring.

Nothing outside this folder imports it. Each module holds one operator with a general interface;
``registry`` derives the registered queries from them.
"""
