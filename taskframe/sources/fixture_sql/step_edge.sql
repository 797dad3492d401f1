select * from (values
 ('ENHANCEMENT', 0, 'SEGMENTATION'), ('SEGMENTATION', 0, 'ANALYSIS'), ('MODEL_PROFILE', 0, 'AVATAR'), ('SHOT_CREATION', 0, 'AVATAR'),
 ('SCRIPT_GENERATION', 0, 'IMAGE_GENERATION'), ('SCRIPT_GENERATION', 1, 'SPEECH_GENERATION'), ('IMAGE_GENERATION', 0, 'VIDEO_GENERATION')
) as t(step, pos, next_step)
