select * from (values
 ('ENHANCEMENT', 'identification', 'png', null), ('SEGMENTATION', 'segmentation', 'png', null),
 ('ANALYSIS', 'analysis', 'json', null), ('VIRTUAL_TRY', 'vton', 'png', null), ('AVATAR', 'avatar', 'png', null),
 ('MODEL_PROFILE', 'model_profile', 'png', null), ('SHOT_CREATION', 'shot', 'png', null),
 ('SCRIPT_GENERATION', 'script', 'json', null), ('IMAGE_GENERATION', 'image', 'png', null),
 ('VIDEO_GENERATION', 'animate', 'mp4', 'STITCH'), ('SPEECH_GENERATION', 'tts', 'mp3', null), ('STITCH', 'stitch', 'mp4', null)
) as t(step, queue, filetype, join_to)
