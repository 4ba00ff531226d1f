"""Shared fixture schemas and a small acyclic citation graph."""

H1 = "hop1_id string, hop0_id string, hop1_title string, hop1_abstract string, hop1_year int, intent_label string, citation_text string, seq int"
H2 = "hop2_id string, hop1_id string, hop2_title string, hop2_abstract string, hop2_year int, citation_text string, seq int"
H0 = "source_paper_id string, title string, abstract string, year int"


def citing_pairs(n):
    return [(f"n{i}", f"n{j}") for i in range(n) for j in range(i) if (i * 5 + j * 3) % 7 == 0 or j == i // 2]
