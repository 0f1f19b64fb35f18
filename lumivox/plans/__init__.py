"""Building blocks that span several jobs: lineage cuts in the shared folder and iterative graph plans."""
