"""Declared schemas."""

ITEM = "query string, answer array<string>, bbox array<array<double>>, image_path string"
DOCUMENT = f"items array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ITEM.split(', '))}>>"
METRIC = "type string, global_step bigint, virtual_batch_counter bigint, batch_idx bigint, loss double"
TRAINER_STATE = (
    "global_step bigint, virtual_batch_counter bigint, best_val_loss double, use_peft boolean, "
    "lora_config struct<r: int, lora_alpha: double, lora_dropout: double, bias: string, target_modules: array<string>, modules_to_save: array<string>>"
)
