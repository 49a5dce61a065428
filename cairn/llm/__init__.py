"""Training-data operators: one module per operator, each with its own general interface.

``cairn.llm.queries`` holds the thin contract queries.  Nothing outside this
package imports it.
"""
