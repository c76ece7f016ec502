"""Table operators: detection, fusion, validation, resolution, synthesis, rewriting, evaluation."""
