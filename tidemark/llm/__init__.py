"""Training-data operators over edits, captures and page versions.

Every operator takes the library's own records, an edit being ``(rev_id, diff)`` with
``diff`` its text, and returns DataFrames. Nothing outside this folder imports it.
"""
