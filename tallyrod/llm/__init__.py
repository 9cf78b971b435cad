"""Operations of a training-data pipeline: each module holds one, `queries` names them for the entry point."""
